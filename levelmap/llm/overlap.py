"""Near copies by the Jaccard similarity of their shingles, exactly, by prefix filtering.

Order all shingles in any one way. If two texts have a similarity of `least`, they share
one of the first n - least * n + 1 of either, so texts are indexed under those only and no pair is lost.
The order puts frequent shingles last: a first pass counts them in cells by hash, and cells that have the
square root of the number of texts above the mean come after the others. Cells only decide how many
candidates there are, never which pairs link. Candidates are compared by their whole sets of shingles.

Most keys have one text. An aggregate finds those of several, straight from the texts, and only their part of
the index is written. Under a key every text is first compared with one of it, which joins groups of copies;
only what these links leave apart is compared pair by pair. Pairs found otherwise (`met`) join the first of these
comparisons.

Before whole sets move, pairs are told apart by sketches: each shingle flips one of 2^SKETCH_BITS bits, so that two
sketches differ in no more bits than their sets in shingles, and no similar pair is lost. Those of large sets are
full and rule out little, so what they leave is told apart by others that have a bit for each shingle or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import added_blocks, discard, expanded, keep, squeezed, text_bytes, thrifty
from levelmap.llm.groups import components

#: Shares as numerator and denominator, so that bounds are whole numbers.
LEAST = (4, 5)
CELL_BITS, BLOCK_BITS = 22, 19
SKETCH_BITS = 10
CHUNK = 1 << 16
RARE = 32
Met = Callable[[DataFrame], DataFrame]


def shingle_hashes(text: bytes, words_in_shingle: int) -> np.ndarray:
    """XXH64 of the shingles in order; A-Z are lower-cased and words are what ASCII white space separates."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    k = min(words_in_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest, seed = xxhash.xxh64_intdigest, 42
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: majority of the hashes' bits; 0 without any."""
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8)
        set_in += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes)).view(">i8")[0])


def _sketch(own: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles by their upper bits, as longs."""
    cells = (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=1 << SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def _wide_sketch(own: np.ndarray) -> np.ndarray | None:
    """Of a set of more shingles than `_sketch` has bits, their parities by their lower bits, in a power of two that is
    at least their number; the halves of a sketch, one flipped by the other, are that of half the bits."""
    if len(own) <= 1 << SKETCH_BITS:
        return None
    bits = 1 << (len(own) - 1).bit_length()
    cells = (own & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _set_of(text: bytes, words_in_shingle: int) -> tuple[int, np.ndarray]:
    """The name of a text's set of shingles, and the set in order."""
    own = np.unique(shingle_hashes(text, words_in_shingle))
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).astype(np.int64)), own


def _sets_of(docs: DataFrame, words_in_shingle: int, bits: int) -> DataFrame:
    """(doc_id, id, n, fp, sketch, wide) of every row, and the counts of shingles by cell in blocks (doc_id null, n -1)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.int64), set()
        names = ["doc_id", "id", "n", "fp", "sketch", "wide", "block", "data"]
        kinds = (*(pa.int64(),) * 4, *(pa.list_(pa.int64()),) * 2, pa.int32(), pa.binary())
        for batch in batches:
            found = [_set_of(t.as_py(), words_in_shingle) for t in batch.column(1)]
            fresh = {i: s for i, s in found if i not in seen}
            seen |= fresh.keys()
            if fresh:
                cells = np.concatenate([*fresh.values()]) & np.uint64((1 << bits) - 1)
                counts += np.bincount(cells.astype(np.int64), minlength=1 << bits)
            rows = batch.num_rows
            made = [(i, len(s), fingerprint_of(s), _sketch(s), _wide_sketch(s)) for i, s in found]
            columns = [pa.array([m[k] for m in made], kinds[k + 1]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if not seen:
            return
        for block, part in enumerate(np.split(counts, max(1, len(counts) >> BLOCK_BITS))):
            if part.any():
                row = (None, 0, -1, 0, None, None, block, squeezed(part))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        thrifty(each), "doc_id long, id long, n long, fp long, sketch array<long>, wide array<long>, block int, data binary"
    )


def _index(docs: DataFrame, words_in_shingle: int, least: tuple[int, int], bits: int, frequent) -> DataFrame:
    """(key, id, n, at): the sets under the first of their shingles, at which place."""
    up, of = least

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = np.zeros(1 << bits, bool), set()
        late[frequent.value] = True
        for batch in batches:
            keys, ids, sizes = [], [], []
            for text in batch.column(0):
                name, own = _set_of(text.as_py(), words_in_shingle)
                if name in seen or not len(own):
                    continue
                seen.add(name)
                first = len(own) - -(-up * len(own) // of) + 1
                order = np.argsort(late[(own & np.uint64((1 << bits) - 1)).astype(np.int64)], kind="stable")[:first]
                keys.append(own[order].view(np.int64))
                ids.append(name)
                sizes.append(len(own))
            if keys:
                each_of = [len(k) for k in keys]
                columns = np.concatenate(keys), np.repeat(np.array(ids, np.int64), each_of), np.repeat(sizes, each_of), np.concatenate([np.arange(n) for n in each_of])
                columns = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n", "at"])

    return docs.select(text_bytes().alias("text")).mapInArrow(thrifty(each), "key long, id long, n int, at int")


def _compared(pairs: DataFrame, docs: DataFrame, first: DataFrame, words_in_shingle: int, least: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) of sets those that are similar enough."""
    sizes = [first.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    wide = [first.select(F.col("id").alias(x), F.col("wide").alias(f"sketch_{x}")) for x in "ab"]

    def halved(x: str, y: str) -> str:
        n = f"size(sketch_{y})"
        return f"if(size(sketch_{x}) > {n}, zip_with(slice(sketch_{x}, 1, {n}), slice(sketch_{x}, {n} + 1, {n}), (x, y) -> x ^ y), sketch_{x})"

    differ = F.expr(f"aggregate(zip_with({halved('a', 'b')}, {halved('b', 'a')}, (x, y) -> bit_count(x ^ y)), 0, (t, c) -> t + c)")
    # Sets of sizes n and m with this similarity differ in (n + m) (of - up) / (of + up) shingles at most.
    close = differ * (least[1] + least[0]) <= (F.col("n_a") + F.col("n_b")) * (least[1] - least[0])
    near = keep(pairs.join(sizes[0], "a").join(sizes[1], "b").filter(close & _may_match("n_a", "n_b", least)).select("a", "b", "n_a", "n_b"))
    # Sets that may match differ by a factor of two at most in the bits of their sketches.
    told = near.join(wide[0], "a").join(wide[1], "b").filter(F.isnull("sketch_a") | F.isnull("sketch_b") | close)
    pairs = keep(told.select("a", "b"))
    discard(near)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_set_of(t.as_py(), words_in_shingle) for t in batch.column(0)]
            sets = pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), sets], ["id", "own"])

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    holders = first.join(wanted, "id", "left_semi").select(F.col("first_id").alias("doc_id"))
    texts = docs.join(holders, "doc_id", "left_semi").select(text_bytes().alias("text"))
    sets = keep(texts.mapInArrow(thrifty(each), "id long, own array<long>").dropDuplicates(["id"]))
    met = pairs.join(sets.withColumnsRenamed({"id": "a", "own": "own_a"}), "a").join(sets.withColumnsRenamed({"id": "b", "own": "own_b"}), "b")
    both = F.size(F.array_intersect("own_a", "own_b"))
    enough = both * least[1] >= (F.size("own_a") + F.size("own_b") - both) * least[0]
    similar = keep(met.filter(enough).select("a", "b"))
    discard(sets, pairs)
    return similar


def _may_match(n: Column | str, m: Column | str, least: tuple[int, int]) -> Column:
    """Whether sets of sizes n and m can be similar enough."""
    return F.least(n, m) * least[1] >= F.greatest(n, m) * least[0]


def links(
    docs: DataFrame, sets: DataFrame, frequent, bits: int, *, words_in_shingle: int, least: tuple[int, int] = LEAST, met: Met | None = None
) -> DataFrame:
    """(a, b): pairs of sets that are similar enough, as many as join all that such pairs join."""
    alone = [F.first(c).alias(c) for c in ("n", "fp", "sketch", "wide")]
    first = keep(sets.groupBy("id").agg(F.min("doc_id").alias("first_id"), *alone))
    index = _index(docs, words_in_shingle, least, bits, frequent)
    ends = index.groupBy("key").agg(F.min("id").alias("least_id"), F.max("id").alias("most"))
    several = keep(ends.filter("least_id < most").drop("most"))
    shared = keep(index.join(several, "key").dropDuplicates(["key", "id"]))
    discard(several)
    stars = shared.filter("id <> least_id").select(F.col("least_id").alias("a"), F.col("id").alias("b"), "n").distinct()
    sizes = first.select(F.col("id").alias("a"), F.col("n").alias("m"))
    alike = stars.join(sizes, "a").filter(_may_match("n", "m", least)).select("a", "b")
    alike = keep(alike.union(met(first.select("id", "fp"))).distinct() if met else alike)
    joined = _compared(alike, docs, first, words_in_shingle, least)
    roots = components(joined)
    placed = shared.join(roots, shared.id == roots.node, "left").select("key", "id", "n", "at", F.coalesce("root", "id").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    left = keep(placed.join(apart, "key", "left_semi"))
    discard(shared, alike, roots)
    x, y = left.alias("x"), left.alias("y")
    # What the sets can share if this is the first shingle of the order that both have.
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fits = most * (least[0] + least[1]) >= (F.col("x.n") + F.col("y.n")) * least[0]
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & fits)
    pairs = keep(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    discard(left)
    more = _compared(pairs, docs, first, words_in_shingle, least)
    discard(pairs, first)
    return joined.union(more)


def near_copies(
    docs: DataFrame, *, words_in_shingle: int, least: tuple[int, int] = LEAST, bits: int = CELL_BITS, met: Met | None = None
) -> DataFrame:
    """(doc_id, component_id) for every row of `docs` (doc_id, text), whose doc_ids must not be null.

    Documents link if their sets of shingles have a Jaccard similarity of `least` or more; shingles have
    fewer words only where the whole text has. Texts without words have equal sets. component_id is the
    smallest doc_id reachable, itself included. `met` makes pairs (a, b) to be compared first from the sets'
    names and SimHash fingerprints (id, fp).
    """
    found = keep(_sets_of(docs, words_in_shingle, bits))
    sets = found.filter("n >= 0").select("doc_id", "id", "n", "fp", "sketch", "wide")
    floor = max(RARE, sets.count() ** 0.5) + (sets.groupBy().sum("n").first()[0] or 0) / (1 << bits)
    parts = found.filter("n < 0").select("block", F.lit(0).alias("sub"), "data")
    late = [np.empty(0, np.int64)]
    late += [np.flatnonzero(expanded(bytes(r.data), np.int64) >= floor) + (r.block << BLOCK_BITS) for r in added_blocks(parts).toLocalIterator()]
    frequent = docs.sparkSession.sparkContext.broadcast(np.concatenate(late))
    linked = links(docs, sets, frequent, bits, words_in_shingle=words_in_shingle, least=least, met=met)
    roots = components(linked)
    named = sets.join(roots, sets.id == roots.node, "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("doc_id", "component_id")
