"""Packing along a space-filling curve.

A document's token ids are hashed to a vector, the vector is projected to a few dimensions, and
its cell there has a place on the Hilbert curve. Documents are range-sorted by that place, so
neighbours on the curve share sequences, and are laid end to end into sequences of fixed length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from levelmap.llm.common import keep, text_of, thrifty

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 2048
END = 1
BUCKETS, DIMS, BITS = 4096, 4, 12


@lru_cache(1)
def _model(path: str) -> Tokenizer:
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    return model


def _file(path: str) -> dict:
    model = Tokenizer.from_file(path)
    if model.get_vocab_size() > 1 << 16:
        raise ValueError("two bytes an id are too few for this vocabulary")
    return json.loads(model.to_str())


@lru_cache(1)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """From a text to its ids as `tokenizers` gives them for the file at `path`, without special tokens.

    Where the file is plain byte-level BPE with its merges in the order of their ids, these ids are
    ranks, and `tiktoken` finds the same ids from the file's vocabulary in less than half the time.
    Any other file is left to `tokenizers`, and so is a text that `tiktoken` gives up on. A worker makes it
    once, and holds a model of `tokenizers` only where one is used.
    """
    file = _file(path)
    ranks = _ranks(file)
    del file
    if ranks:
        ranked = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(text: str) -> np.ndarray:
        return np.array(_model(path).encode(text, add_special_tokens=False).ids, "<u2")

    def fast(text: str) -> np.ndarray:
        try:
            return ranked.encode_to_numpy(text, disallowed_special=()).astype("<u2")
        except ValueError:  # its pattern gives up on very long runs of white space
            return plain(text)

    return fast if ranks else plain


def _ranks(file: dict) -> dict[bytes, int] | None:
    """Byte strings of the ids of a byte-level BPE file; None if ids are not ranks of merges there."""
    bpe, split = file["model"], file["pre_tokenizer"] or {}
    plain = bpe["type"] == "BPE" and not file["normalizer"] and split.get("type") == "ByteLevel"
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if not plain or split["add_prefix_space"] or not split["use_regex"] or any(bpe.get(k) for k in odd):
        return None
    merged = [bpe["vocab"]["".join(m)] for m in bpe["merges"]]
    if merged != list(range(256, len(bpe["vocab"]))):
        return None
    # The format writes visible bytes as themselves and the others, in order, as characters from 256 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    byte_of = {chr(x): x for x in visible} | {chr(256 + n): x for n, x in enumerate(hidden)}
    return {bytes(map(byte_of.__getitem__, word)): n for word, n in bpe["vocab"].items()}


def _hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows of `DIMS` coordinates of `bits` bits): Gray-code
    untangling from the highest bit down, then interleaving."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= t
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> level & 1)
    return place


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert places of documents: root counts of hashed ids, scaled to length 1, projected by fixed Gaussians."""
    project = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    flat = np.zeros((len(ids), DIMS))
    for row, own in enumerate(ids):
        if len(own):
            hashed = (own.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
            bucket, count = np.unique(hashed, return_counts=True)
            weight = np.sqrt(count)
            flat[row] = weight @ project[bucket] / np.sqrt(count.sum())
    cells = np.clip((flat + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return _hilbert(cells, BITS)


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(doc_id, place, n, ids binary of two-byte ids, the closing id included) for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(tokenizer), np.array([end], "<u2")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                whole = [np.r_[x, close] for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(curve_keys(ids), pa.int64()),
                        pa.array([len(x) for x in whole], pa.int64()),
                        pa.array([x.tobytes() for x in whole], pa.binary()),
                    ],
                    ["doc_id", "place", "n", "ids"],
                )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(thrifty(each), "doc_id long, place long, n long, ids binary")


class _Sequences:
    """Lays documents end to end; a sequence is given out when it is full."""

    def __init__(self, first: int, length: int):
        self.next, self.length, self.open, self.filled = first, length, [], 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.length - self.filled)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.filled += take
            at += take
            if self.filled == self.length:
                self._give(self.length)

    def _give(self, length: int) -> None:
        """One sequence of `length` tokens from the front of what is open."""
        offset = 0
        while offset < length:
            doc_id, start, ids, whole = self.open[0]
            own = ids[: length - offset]
            self.rows.append((doc_id, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), whole, self.next, offset, own.tobytes()))
            offset += len(own)
            if len(own) == len(ids):
                self.open.pop(0)
            else:
                self.open[0] = (doc_id, start + len(own), ids[len(own) :], whole)
        self.filled -= length
        self.next += 1

    def close(self) -> None:
        """What is left of the stretch goes into sequences of powers of two, which need no padding."""
        for bit in range(self.length.bit_length() - 1, -1, -1):
            if self.filled >> bit & 1:
                self._give(1 << bit)


def sequences(docs: DataFrame, *, tokenizer: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Pieces of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every id of every row lies in one piece (`ids` holds them as two-byte numbers). A null text
    counts as empty and has the closing id alone; repeated rows are packed each. A sequence has
    `length` tokens, but for the last ones of each sorted partition, which together have fewer
    than `length` and are of falling powers of two. Partitions are ranges of (place, doc_id), so
    that copies of one text may spread over several. An empty table gives an empty result.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = keep(tokenized(docs, path))
    order = ["place", "doc_id", "n", "digest"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("digest", F.crc32("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Sequences(TaskContext.get().partitionId() << 40, length)

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*packer.rows, strict=True), schema, strict=True)], schema=schema)
            packer.rows = []
            return made

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_py(), "<u2"))
                if len(packer.rows) >= 10_000:
                    yield given()
        packer.close()
        if packer.rows:
            yield given()

    sql_types = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema)
    return ranged.select("doc_id", "ids").mapInArrow(thrifty(pack), sql_types)
