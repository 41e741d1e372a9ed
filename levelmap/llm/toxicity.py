"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts have a model each of two orders. The upper one counts the texts of the class that have a
word after another, discounted, and gives what that frees to the lower one. The lower one is made of continuation
counts: a word counts by the number of distinct words it follows in texts of the class, not by how often it is
repeated; what their discount frees goes to the continuation counts of all texts. Either order has a mass besides
that both classes share, so that an expression met a few times says little and one met in neither class next to
nothing. Each model sums to 1 over all words, after any word. A document is scored by the difference of its
log-likelihoods under both, by the lower order alone and by both orders: per word over the whole text, over its
most toxic window and at its most toxic word; a logistic curve turns these into a probability.

Counts cover all learning rows but those, CALIBRATION_ROWS at most or so, that set the curve. Words are
hashed to 2^22 cells, contexts to 2^16 and pairs to 2^23, so the model has one size at any size of the input,
which bounds what is collected and broadcast; words or pairs of one cell share their counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import WordHashes, added_blocks, expanded, held_out, slices, squeezed, text_of, thrifty

WORD_BITS, CONTEXT_BITS, BLOCK_BITS = 22, 16, 16
BLOCKS, BLOCK, CONTEXTS = 1 << (WORD_BITS - BLOCK_BITS), 1 << BLOCK_BITS, 1 << CONTEXT_BITS
DISCOUNT = 0.75
#: The backoff's own mass, in units of all counts of the smaller class.
SHARED = 64.0
#: The mass of what both classes have after a word, in units of the smaller class's count of it.
SHARED_PAIRS = 256.0
#: Pairs are counted in 2^17 cells for each block of the words they begin with, 2^23 in all.
PAIR_BITS = 17
FEATURES = 7
WINDOW = 16
THRESHOLD = 0.7
CALIBRATION_ROWS = 20_000
CHARS, RUN_CHARS = 1 << 18, 1 << 23
WORDS = re.compile(r"\w+")


def keys_of(texts: list[str], memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with their contexts as 38-bit keys, cell then context; the same pairs by the cell of the word before,
    then the word; where a text has a key for the first time; and each text's number of words.

    The context of a text's first word is 0. A pair counts once a text, so that a word repeated
    over and over is one expression.
    """
    words = [WORDS.findall(t.lower()) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    hashes = memo.of([w for own in words for w in own])
    cell = hashes & np.uint64((1 << WORD_BITS) - 1)
    short = (hashes >> np.uint64(WORD_BITS)) & np.uint64(CONTEXTS - 1)
    context, before = np.r_[np.uint64(0), short][:-1], np.r_[np.uint64(0), cell][:-1]
    if len(cell):
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        context[starts] = before[starts] = 0
    keys = cell << np.uint64(CONTEXT_BITS) | context
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    first = np.zeros(len(keys), bool)
    first[np.unique(text << np.uint64(WORD_BITS + CONTEXT_BITS) | keys, return_index=True)[1]] = True
    return keys, before << np.uint64(WORD_BITS) | cell, first, lengths


def _parts(pairs: np.ndarray, bits: int, subs: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of pairs, in order, by block of their first half and sub of their second, which has `bits`."""
    part = ((pairs >> np.uint64(bits + BLOCK_BITS)) * np.uint64(subs) + pairs % np.uint64(subs)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for lo, hi in zip(cut, [*cut[1:], len(part)], strict=True) if len(part) else []:
        yield int(part[lo]), order[lo:hi]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; empties the list."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def _packed(pairs: np.ndarray, kind) -> bytes:
    """Pairs of one block, in order: word within its block, then the other."""
    return squeezed(np.r_[pairs[:1], np.diff(pairs)].astype(kind))


def _unpacked(data: list[bytes], kind) -> np.ndarray:
    return np.concatenate([np.cumsum(expanded(d, kind), dtype=kind) for d in data])


def pair_counts(learning: DataFrame, subs: int) -> DataFrame:
    """Per task, block and sub: the distinct pairs of a class whose word is in the block, and those that begin with
    a word of the block (`follow`) with the number of texts that have them (`texts`)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            lengths = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for at, end in slices(lengths, RUN_CHARS):
                yield from counted(batch.slice(at, end - at), lengths[at:end], memo)

    def counted(batch: pa.RecordBatch, sizes: np.ndarray, memo: WordHashes) -> Iterator[pa.RecordBatch]:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        keys: tuple[list, list] = ([], [])
        after: tuple[list, list] = ([], [])
        for lo, hi in slices(sizes, CHARS):
            own, follow, first, lengths = keys_of(batch.column(0).slice(lo, hi - lo).to_pylist(), memo)
            of = np.repeat(toxic[lo:hi], lengths)[first]
            for k in (0, 1):
                keys[k].append(own[first][of == k])
                after[k].append(follow[first][of == k])
        rows = []
        for k in (0, 1):
            pairs = _joined(keys[k])
            pairs = np.unique(pairs)
            for where, at in _parts(pairs, CONTEXT_BITS, subs):
                rows.append((where // subs, where % subs, k, _packed(pairs[at].astype(np.uint32), np.uint32), None, None))
            pairs = _joined(after[k])
            pairs, texts_with = np.unique(pairs, return_counts=True)
            for where, at in _parts(pairs, WORD_BITS, subs):
                follow = _packed(pairs[at] & np.uint64((1 << BLOCK_BITS + WORD_BITS) - 1), np.uint64)
                rows.append((where // subs, where % subs, k, None, follow, squeezed(texts_with[at].astype(np.uint32))))
        if rows:
            kinds = (pa.int32(),) * 3 + (pa.binary(),) * 3
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "sub", "toxic", "pairs", "follow", "texts"])

    return learning.select("text", F.col("toxic").cast("int")).mapInArrow(
        thrifty(each), "block int, sub int, toxic int, pairs binary, follow binary, texts binary"
    )


def _tables(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of a block and sub, for each class: the words' distinct contexts."""
    return pd.DataFrame({"block": frame.block[:1], "sub": frame["sub"][:1], "data": [squeezed(_contexts_of(frame))]})


def _contexts_of(frame: pd.DataFrame) -> np.ndarray:
    out = np.zeros((2, BLOCK), np.int64)
    for k in (0, 1):
        own = frame.pairs[(frame.toxic == k) & frame.pairs.notna()]
        if len(own):
            out[k] = np.bincount(np.unique(_unpacked(own, np.uint32)) >> CONTEXT_BITS, minlength=BLOCK)
    return out


def pair_cells(follow: np.ndarray) -> np.ndarray:
    """Cells of pairs within the block of the word that they begin with."""
    low = follow & np.uint64((1 << BLOCK_BITS + WORD_BITS) - 1)
    return (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _follow_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of a block: both classes' sums of c(v, w) over w, then the distinct w after v in each class and in
    either; and c(v, w) of both classes by cell."""
    sums, cells, all_pairs = np.zeros((5, BLOCK), np.int64), np.zeros((2, 1 << PAIR_BITS), np.int64), []
    for k in (0, 1):
        own = frame[(frame.toxic == k) & frame.follow.notna()]
        if len(own):
            texts = np.concatenate([expanded(t, np.uint32) for t in own.texts])
            pairs, at = np.unique(_unpacked(own.follow, np.uint64), return_inverse=True)
            texts = np.bincount(at, texts, len(pairs)).astype(np.int64)
            words = (pairs >> np.uint64(WORD_BITS)).astype(np.int64)
            sums[k] = np.bincount(words, texts, BLOCK)
            sums[2 + k] = np.bincount(words, minlength=BLOCK)
            cells[k] = np.bincount(pair_cells(pairs), texts, 1 << PAIR_BITS)
            all_pairs.append(pairs)
    if all_pairs:
        either = np.unique(np.concatenate(all_pairs)) >> np.uint64(WORD_BITS)
        sums[4] = np.bincount(either.astype(np.int64), minlength=BLOCK)
    return sums, cells


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    """All counts of a block and sub: those of `_tables` and of `_follow_of`, one after the other."""
    sums, cells = _follow_of(frame)
    data = np.concatenate([_contexts_of(frame).ravel(), sums.ravel(), cells.ravel()])
    return pd.DataFrame({"block": frame.block[:1], "sub": frame["sub"][:1], "data": [squeezed(data)]})


def _by_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts with their lowest bytes first, then the next, as they pack best."""
    for frame in frames:
        yield pd.DataFrame({"block": frame.block, "data": [_lowest_first(expanded(d, np.int64)) for d in frame.data]})


def _lowest_first(counts: np.ndarray) -> bytes:
    return squeezed(counts.view(np.uint8).reshape(-1, 8).T)


def counted_blocks(parts: DataFrame) -> DataFrame:
    """The counts of `pair_counts` summed to one row (block, data) per block, packed as by `_by_bytes`.

    No stage has two Python steps, so that a task needs one worker and not two, which stay after it. A block has
    one row per sub to be summed.
    """

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        total = expanded(frame.data[0], np.int64).copy()
        for data in frame.data[1:]:
            total += expanded(data, np.int64)
        return pd.DataFrame({"block": frame.block[:1], "data": [_lowest_first(total)]})

    tables = parts.groupBy("block", "sub").applyInPandas(_counted, "block int, sub int, data binary")
    return tables.groupBy("block").applyInPandas(whole, "block int, data binary")


class Blocks:
    """The model's blocks as they are collected and broadcast, compressed; a worker expands them once."""

    def __init__(self, blocks: list[tuple[int, bytes]]):
        self.blocks, self.expanded = blocks, None

    def model(self) -> Model:
        if self.expanded is None:
            self.expanded, self.blocks = Model.of(self.blocks), []
        return self.expanded

    def __getstate__(self) -> dict:
        return {"blocks": self.blocks, "expanded": None}


def log_probabilities(contexts_of: np.ndarray) -> np.ndarray:
    """Of both classes, for each word and, last, for any word of neither: its log-probability, from the
    distinct contexts n_k(w) of words in each class.

    p_k(w) = (max(n_k(w) - D, 0) + (D V_k + M) b(w)) / (n_k + M), with V_k the words of the class, n_k all its
    counts, M the shared mass, and b(w) the share of w in both classes' counts with one more for each word
    and for those of neither.
    """
    counts = np.concatenate([contexts_of, np.zeros((2, 1), contexts_of.dtype)], 1).astype(np.float64)
    both = counts.sum(0)
    backoff = (both + 1) / (both.sum() + np.count_nonzero(both) + 1)
    total, types = counts.sum(1)[:, None], np.count_nonzero(counts, axis=1)[:, None]
    mass = SHARED * total.min()
    with np.errstate(divide="ignore", invalid="ignore"):
        known = (np.maximum(counts - DISCOUNT, 0) + (DISCOUNT * types + mass) * backoff) / (total + mass)
    return np.log(np.where(total + mass > 0, known, backoff))


def pair_probabilities(known: np.ndarray, sums: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Of both classes, p_k(w|v) from c_k(v, w), from the sums of v as in `_follow_of`, and from p_k(w).

    p_k(w|v) = (max(c_k(v, w) - D, 0) + D N_k(v) p_k(w) + M(v) q_k(w|v)) / (c_k(v) + M(v)), with c_k(v) the sum of
    c_k(v, w), N_k(v) the number of w that follow v, and M(v) the mass shared. q_k is the same without M from the
    counts of both classes, so that a pair that the smaller class has not the texts for says little. After a v of
    neither class it is p_k(w).
    """
    total, after = sums[:2], sums[2:4]
    known = np.minimum(known, total)
    both, of_both = known.sum(0), total.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        shared = (np.maximum(both - DISCOUNT, 0) + DISCOUNT * sums[4] * lower) / of_both
    shared = np.where(of_both > 0, shared, lower)
    mass = SHARED_PAIRS * total.min(0) + 1
    return (np.maximum(known - DISCOUNT, 0) + DISCOUNT * after * lower + mass * shared) / (total + mass)


@dataclass
class Model:
    """Of the cells that have words their place among these, 0 for all others, and by place p_k(w) and the sums of
    `_follow_of`. The roots of c_k(v, w) by cell take half the room, and counts below 1,000 come out whole."""

    place: np.ndarray
    lower: np.ndarray
    sums: np.ndarray
    roots: np.ndarray
    told: bool

    @staticmethod
    def of(blocks: list[tuple[int, bytes]]) -> Model:
        place = np.zeros((BLOCKS, BLOCK), np.int32)
        roots = np.zeros((BLOCKS, 1 << PAIR_BITS, 2), np.float16)
        words, sums, places = [np.zeros((2, 0))], [np.zeros((5, 1), np.float32)], 1
        for block, data in blocks:
            counts = np.ascontiguousarray(expanded(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
            contexts, own, cells = np.split(counts, [2 * BLOCK, 7 * BLOCK])
            contexts, own = contexts.reshape(2, BLOCK), own.reshape(5, BLOCK)
            met = np.flatnonzero(contexts.any(0) | own.any(0))
            place[block, met] = np.arange(places, places + len(met))
            words.append(contexts[:, met])
            sums.append(own[:, met].astype(np.float32))
            roots[block] = np.sqrt(cells.reshape(2, -1).T)
            places += len(met)
        counts = np.concatenate(words, 1)
        # The last is that of a word of neither class.
        lower = np.roll(np.exp(log_probabilities(counts)), 1, 1).astype(np.float32)
        # A class without any text tells nothing.
        return Model(place.ravel(), lower, np.concatenate(sums, 1), roots, bool(counts.any(1).all()))

    def probabilities(self, keys: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words after the word before each, p_k(w) and p_k(w|v) of both classes."""
        lower = self.lower[:, self.place[(keys >> np.uint64(CONTEXT_BITS)).astype(np.int64)]].astype(np.float64)
        before = (follow >> np.uint64(WORD_BITS)).astype(np.int64)
        known = np.rint(np.square(self.roots[before >> BLOCK_BITS, pair_cells(follow)].T.astype(np.float64)))
        return lower, pair_probabilities(known, self.sums[:, self.place[before]].astype(np.float64), lower)

    def differences(self, keys: np.ndarray, follow: np.ndarray) -> list[np.ndarray]:
        """Toxic less ordinary log-likelihood of each word, by the lower order alone and by pairs."""
        return [np.log(toxic / ordinary) * self.told for ordinary, toxic in self.probabilities(keys, follow)]

    def features(self, texts: list[str], memo: WordHashes) -> np.ndarray:
        """Per text: 1, and by the lower order and by pairs the log-likelihood difference per word, that of its best
        window, and that of its best word. An expression counts where a text has it for the first time."""
        keys, follow, first, lengths = keys_of(texts, memo)
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1
        for column, gain in zip((1, 4), self.differences(keys, follow), strict=True):
            gain = np.where(first, gain, 0)
            total = np.r_[0, np.cumsum(gain)]
            for row, (hi, n) in enumerate(zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)):
                if n:
                    own, size = total[hi - n : hi + 1], min(WINDOW, n)
                    best = (own[size:] - own[:-size]).max() / size
                    out[row, column : column + 3] = (own[-1] - own[0]) / n, best, gain[hi - n : hi].max()
        return out


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve by Newton's steps, with a small ridge so that separable classes end."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = probability(x, w)
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _runs(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of CHARS characters or so of the column `at`, with its texts; a null one is empty."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in slices(lengths, CHARS):
        run = batch.slice(lo, hi - lo)
        yield run, [t or "" for t in run.column(at).to_pylist()]


def _featured(rows: DataFrame, shared, weights: np.ndarray | None) -> DataFrame:
    """Adds the features (without weights) or the score to rows that have a text column."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, model = WordHashes(), shared.value.model()
        for batch in batches:
            parts = [model.features(texts, memo) for _, texts in _runs(batch, 0)]
            x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            made = pa.array(list(x), pa.list_(pa.float64())) if weights is None else pa.array(probability(x, weights))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "made"])

    kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(thrifty(each), f"{kept}, made {'array<double>' if weights is None else 'double'}")


def fitted(docs: DataFrame, labels: DataFrame):
    """The model as a broadcast, and the curve's weights, from the learning rows of `labels`."""
    spark = docs.sparkSession
    known = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most")
        .drop("most")
    )
    eighth = F.expr("crc32(cast(cast(doc_id as string) as binary)) div 3 % 8 = 0")
    share = min(1.0, CALIBRATION_ROWS / max(1, known.filter(eighth).count()))
    aside = eighth & F.expr(f"pmod(xxhash64(cast(doc_id as string)), 1048576) < {int(share * 1048576)}")
    texts = docs.select("doc_id", text_of().alias("text")).filter(~held_out())
    subs = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BLOCKS)
    learning = texts.filter(~aside).join(known.filter(~aside).hint("shuffle_hash"), "doc_id")
    blocks = counted_blocks(pair_counts(learning, subs))
    shared = spark.sparkContext.broadcast(Blocks([(r.block, bytes(r.data)) for r in blocks.collect()]))

    calibration = texts.filter(aside).join(known.filter(aside).hint("shuffle_hash"), "doc_id")
    frame = _featured(calibration.select("text", "toxic", "doc_id"), shared, None).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(frame.made.tolist()).reshape(-1, FEATURES)
    return shared, logistic(x, frame.toxic.to_numpy(dtype=float)) if len(frame) else np.zeros(FEATURES)


def scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text; other columns are ignored).

    `labels` (doc_id, toxic) is read for rows whose crc32(doc_id) mod 3 is not 1; of these, one
    in eight, but at most about CALIBRATION_ROWS, set the curve and all others are counted. Labels that are null
    or that contradict each other for one id are left out. A null text counts as empty; an empty text
    has no words and gets the curve's value there. A null doc_id is held out. Repeated rows are scored
    each. Without labels every score is 0.5. An empty table gives an empty result.
    """
    shared, weights = fitted(docs, labels)
    rows = docs.select(text_of().alias("text"), "doc_id", held_out().alias("held_out"))
    scored = _featured(rows, shared, weights).withColumnRenamed("made", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score (see `scores`) is below the threshold."""
    shared, weights = fitted(docs, labels)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, model = WordHashes(), shared.value.model()
        for batch in batches:
            for run, texts in _runs(batch, at):
                yield run.filter(pa.array(probability(model.features(texts, memo), weights) < threshold))

    return docs.mapInArrow(thrifty(each), docs.schema)
