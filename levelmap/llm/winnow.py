"""Benchmark passages in documents, found by winnowed fingerprints.

A window is `WINDOW` consecutive words. Its fingerprint is the least hash of the `GRAM`-word grams in
it, so that two equal windows, wherever they stand, keep the same gram: every shared span of `WINDOW`
words or more is met. Documents and benchmark items are joined on their fingerprints; a hit is then
extended to its window, which must be equal by a 128-bit hash of its words, and overlapping windows grow
together to the shared span. An item of fewer words than a window is one window of its own length, and
documents are cut at that length as well: its fingerprint is the hash of all its words.

Words are cut and hashed for a run of texts at a time, on bytes: a word is a run of ASCII digits,
letters and all bytes from 0x80, which are the bytes of every character beyond ASCII.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import keep, slices, text_of

WINDOW = 10
GRAM = 5
#: Documents' fingerprints are first looked up in a bitmap of this many bits, 2 MB at any size of the
#: benchmark. A full bitmap only lets more of them through to the join, which is exact.
FILTER_BITS = 24
_SLICE_BYTES = 1 << 21
_BLOCK = 1 << 16
_LETTERS = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
FOUND = "start int, n int, print long, high long, low long"


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, _BLOCK), _powers(_BACK, _BLOCK)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of consecutive texts: first byte, end, text and hash of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """`bounds` has a text's first byte, and at the end the length of `data`."""
        self.data = data
        inside = _IS_WORD[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        firsts, ends = bounds[:-1], bounds[1:]
        before[firsts[firsts < len(data)]] = False
        after[ends[ends > firsts] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.texts = np.searchsorted(bounds, self.starts, "right") - 1
        self.hashes = _mixed((self._sums(self.ends) - self._sums(self.starts)) * self._back(self.starts) + np.uint64(1))

    def _sums(self, at: np.ndarray) -> np.ndarray:
        """Sums of letters times powers over all bytes before each place, in blocks to bound memory."""
        out, total, place = np.zeros(len(at), np.uint64), np.uint64(0), 0
        for first in range(0, len(self.data), _BLOCK):
            block, scale = self.data[first : first + _BLOCK], np.uint64(pow(_STEP, first, 1 << 64))
            sums = np.add.accumulate(_LETTERS[block] * _UP[: len(block)]) * scale + total
            end = np.searchsorted(at, first + len(block), "right")
            own = at[place:end] - first
            out[place:end] = np.where(own > 0, sums[own - 1], total)
            place, total = end, sums[-1]
        return out

    def _back(self, at: np.ndarray) -> np.ndarray:
        blocks = int(at[-1]) // _BLOCK + 1 if len(at) else 1
        return _DOWN[at % _BLOCK] * _powers(pow(_BACK, _BLOCK, 1 << 64), blocks)[at // _BLOCK]

    def grams(self, n: int) -> np.ndarray:
        """Hashes of n words from each word on, whichever texts those belong to."""
        count = max(0, len(self.hashes) - n + 1)
        out = np.full(count, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(_STEP) + self.hashes[i : i + count]
        return _mixed(out)

    def windows(self, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of n words within one text, and the least hash of a gram in each."""
        count = max(0, len(self.hashes) - n + 1)
        least, width = self.grams(gram), 1
        while width < n - gram + 1:
            step = min(width, n - gram + 1 - width)
            least = np.minimum(least[: max(0, len(least) - step)], least[step:])
            width += step
        at = np.flatnonzero(self.texts[:count] == self.texts[n - 1 : n - 1 + count])
        return at, least[at].view(np.int64)

    def identity(self, at: int, n: int) -> bytes:
        """128 bits for the n words from `at` on, in lower case."""
        spans = zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist())
        return xxhash.xxh3_128_digest(b" ".join(self.lower[s:e] for s, e in spans))

    @functools.cached_property
    def lower(self) -> bytes:
        return _LOWER[self.data].tobytes()


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of texts of bounded size; one text is never cut."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for first, end in slices(np.diff(offsets), _SLICE_BYTES):
        yield first, end, Words(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])


def _window_rows(words: Words, bits: np.ndarray | None, short: list[int], whole: bool) -> tuple[np.ndarray, ...]:
    """(text, start, n, print, high, low) of the windows whose fingerprint is in the bitmap.

    `short` lists lengths below `WINDOW` to cut at as well; with `whole`, only texts of that length are.
    """
    counts = np.bincount(words.texts, minlength=int(words.texts[-1]) + 1 if len(words.texts) else 0)
    before = np.cumsum(counts) - counts
    parts = []
    for n, gram in [(WINDOW, GRAM)] + [(n, n) for n in short]:
        at, prints = words.windows(n, gram)
        if whole and n < WINDOW:
            wanted = counts[words.texts[at]] == n
            at, prints = at[wanted], prints[wanted]
        if bits is not None:
            wanted = _in(bits, prints)
            at, prints = at[wanted], prints[wanted]
        same = np.frombuffer(b"".join(words.identity(a, n) for a in at.tolist()), np.int64).reshape(-1, 2)
        text = words.texts[at]
        parts.append((text, (at - before[text]).astype(np.int32), np.full(len(at), n, np.int32), prints, same[:, 0], same[:, 1]))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _in(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct (print, high, low, n, item) of all items; `item` is the id as a string, empty if null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words in _runs(batch.column(1)):
                text, _, n, prints, high, low = _window_rows(words, None, list(range(1, WINDOW)), True)
                items_of = batch.column(0).take(pa.array(text + first))
                yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(high), pa.array(low), pa.array(n), items_of], ["print", "high", "low", "n", "item"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of().alias("text"))
    return rows.mapInArrow(cut, "print long, high long, low long, n int, item string").distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The fingerprints' upper bits as a bitmap: at most 2^18 longs reach the driver, whatever the items."""
    place = f"shiftrightunsigned(print, {64 - FILTER_BITS})"
    rows = windows.selectExpr(f"shiftright({place}, 6) as word", f"shiftleft(1L, int({place} & 63)) as bit")
    rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows.word.to_numpy(np.int64)] = rows.bits.to_numpy(np.int64).view(np.uint64)
    return out


def _scanned(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """(doc_id, n_words, found) of every document; `found` has the windows that pass the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words in _runs(batch.column(1)):
                text, *columns = _window_rows(words, shared.value, short, False)
                order = np.argsort(text, kind="stable")
                found = pa.StructArray.from_arrays([pa.array(c[order]) for c in columns], ["start", "n", "print", "high", "low"])
                ends = np.searchsorted(text[order], np.arange(end - first + 1)).astype(np.int32)
                n_words = np.bincount(words.texts, minlength=end - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(n_words), pa.ListArray.from_arrays(pa.array(ends), found)],
                    ["doc_id", "n_words", "found"],
                )

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, found array<struct<{FOUND}>>")


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's windows, in order, grown together to spans that neither touch nor overlap."""
    for batch in batches:
        windows = batch.column(1)
        flat, sizes = windows.flatten(), windows.value_lengths().to_numpy()
        own = np.repeat(np.arange(len(sizes)), sizes)
        start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        reach = np.maximum.accumulate(end + (own << 32))
        fresh = np.ones(len(own), bool)
        fresh[1:] = start[1:] + (own[1:] << 32) > reach[:-1]
        last = np.flatnonzero(np.r_[fresh[1:], True]) if len(own) else np.empty(0, np.int64)
        spans = [pa.array(x.astype(np.int32)) for x in (start[fresh], reach[last] - (own[last] << 32))]
        ends = np.searchsorted(own[fresh], np.arange(len(sizes) + 1)).astype(np.int32)
        grown = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(spans, ["start", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), grown, batch.column(2)], ["row", "spans", "owners"])


def leaks(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_words, n_hit, spans, set_id), one row for each row of `docs`, and sets (set_id, items).

    `spans` are the runs of hit words as (start, end), from 0; `n_hit` is their sum. Documents in which
    windows of the same items occur share a `set_id`, whose `items` are their ids as strings in order; it
    is null where none occurs. A null or empty text has no words, no item and no hit. Repeated ids are
    rows of their own among documents and one item among items; a null item id is the empty string. Equal
    windows of many items are one window with one set, however often documents hold it. Other columns are
    not read. Empty tables give no rows, or documents without hits.
    """
    windows = keep(item_windows(items))
    short = sorted(r.n for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect())
    scanned = _scanned(docs, _bitmap(windows), short).withColumn("row", F.monotonically_increasing_id())
    scanned = keep(scanned)
    same = ["print", "high", "low", "n"]
    item_key = [F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit("again"), "item")), F.count(F.lit(1))]
    owned = keep(windows.groupBy(*same).agg(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(item_key))).alias("owners")))
    met = scanned.filter(F.size("found") > 0).select("row", F.inline("found")).join(owned, same)
    window = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    hit = met.groupBy("row").agg(F.array_sort(F.collect_list(window)).alias("windows"), F.array_sort(F.collect_set("owners")).alias("owners"))
    owners = hit.schema["owners"].dataType.simpleString()
    hit = hit.mapInArrow(_grown, f"row long, spans array<struct<start: int, end: int>>, owners {owners}")
    hit = keep(hit.withColumn("set_id", F.sha2(F.to_json(F.struct("owners")), 256)))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    documents = (
        scanned.select("row", "doc_id", "n_words").join(hit.select("row", "set_id", "spans"), "row", "left")
        .withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)")))
        .select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "set_id")
    )
    sets = hit.groupBy("set_id").agg(F.first("owners").alias("owners")).select("set_id", F.explode("owners").alias("owners"))
    # One window of each owner set stands for all: it has the same items.
    one = owned.groupBy("owners").agg(F.min(F.struct(*same)).alias("w")).select("owners", "w.*")
    named = sets.join(one, "owners").join(windows, same).groupBy("set_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return documents, named


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of `docs`."""
    documents, sets = leaks(docs, items)
    sets = keep(sets.select("set_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")))
    return documents.join(sets, "set_id", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
LEAKS_SQL = f"""
with items as (select coalesce(item_id::varchar, '') as item, {_WORDS_SQL} as w from benchmark),
item_windows as (
  select distinct item, least(len(w), {WINDOW}) as n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') as passage
  from (select *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from items where len(w) > 0)),
docs as (select row_number() over () as r, doc_id, {_WORDS_SQL} as w from documents),
doc_windows as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as passage
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i
        from docs, (select distinct n from item_windows) where len(w) >= n)),
hits as (select r, d.n, i, item from doc_windows d join item_windows using (n, passage)),
words as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as at from hits) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (r) left join named using (r)
"""
