"""Exact top-k search by inner product over KD-trees, one for each shard of the vectors.

A tree splits its vectors at medians; every node has a tight bounding box, hence a bound on the
inner product of a query with anything below it. Leaves are visited best bound first, some at a time, by
the queries of a block whose k-th score so far they could reach, and those scores are carried on from
shard to shard. Vectors of many dimensions and like norms leave such bounds little to prune: there the
work is that of scoring all pairs of a query and a vector, in matrix products.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.llm.vectors import longs, whole_vectors

SCALE = 64
TOP = 20
EVERY = 20
SHARD_ROWS = 8192
BLOCK_ROWS = 512
LEAF = 128
#: Leaves that are scored in one matrix product.
LEAVES = 8


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(vectors) -> np.ndarray:
    """Rows of whole numbers, as few bytes each as hold them; short rows end in zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    for kind in (np.int8, np.int16, np.int32):
        if not out.size or (out.min() >= np.iinfo(kind).min and out.max() <= np.iinfo(kind).max):
            return out.astype(kind)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in floating point where every sum stays below 2^53, else in whole
    numbers, unbounded ones where a sum could leave a long."""
    top = int(max(a.max(initial=0), -int(a.min(initial=0)))) * int(max(b.max(initial=0), -int(b.min(initial=0)))) * a.shape[-1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    kind = np.int64 if top < 2**62 else object
    return a.astype(kind) @ b.astype(kind)


def build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A tree: vectors in leaf order, and for each node its box, its children, and its run of vectors."""
    order = np.lexsort((ids,))
    low, high, child, run = [], [], [], []

    def node(at: int, end: int) -> int:
        own = vectors[order[at:end]]
        me = len(low)
        low.append(own.min(0))
        high.append(own.max(0))
        child.append((-1, -1))
        run.append((at, end))
        spread = high[me].astype(np.float64) - low[me]
        if end - at > LEAF and spread.max(initial=0) > 0:
            axis = int(spread.argmax())
            half = (end - at) // 2
            order[at:end] = order[at:end][np.argpartition(own[:, axis], half)]
            child[me] = (node(at, at + half), node(at + half, end))
        return me

    node(0, len(ids))
    return _packed(ids=ids[order], vectors=vectors[order], low=np.array(low), high=np.array(high), child=np.array(child), run=np.array(run))


class _Best:
    """The best candidates of each query of a block so far, by score and then by smaller id, as flat arrays."""

    def __init__(self, queries: int, most: int):
        self.queries, self.most = queries, most
        self.row, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = self._lowest(np.int64)

    def _lowest(self, kind) -> np.ndarray:
        return np.full(self.queries, -(1 << 63) if kind != object else -(1 << 200), kind)

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, ids, scores = np.r_[self.row, row], np.r_[self.ids, ids], np.r_[self.scores, scores]
        if scores.dtype == object:
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -scores[i], ids[i])), np.int64)
        else:
            order = np.lexsort((ids, -scores, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, place = order[place < self.most], row[place < self.most], place[place < self.most]
        self.row, self.ids, self.scores = row, ids[order], scores[order]
        self.floor = self._lowest(scores.dtype)
        full = place == self.most - 1
        self.floor[row[full]] = self.scores[full]


def search(tree, queries: np.ndarray, own: np.ndarray, best: _Best) -> None:
    """Adds a tree's candidates to the best of each query; `own` holds the queries' ids.

    Leaves are taken best bound first, some at a time, each time by those queries whose k-th score so far
    they could reach; all of these are scored in one product.
    """
    ids, vectors, child, run = (tree[k] for k in ("ids", "vectors", "child", "run"))
    width = max(queries.shape[1], vectors.shape[1])

    def wide(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, width - x.shape[1])))

    asked, vectors = wide(queries), wide(vectors)
    leaves = np.flatnonzero(child[:, 0] < 0)
    low, high = wide(tree["low"])[leaves], wide(tree["high"])[leaves]
    bounds = _products(np.maximum(asked, 0), high.T) + _products(np.minimum(asked, 0), low.T)
    order = np.argsort(bounds.max(0), kind="stable")[::-1] if len(asked) else leaves[:0]
    for at in range(0, len(order), LEAVES):
        taken = order[at : at + LEAVES]
        row = np.flatnonzero((bounds[:, taken] >= best.floor[:, None]).any(1))
        if len(row):
            place = np.concatenate([np.arange(*run[leaf]) for leaf in leaves[taken]])
            scores, other = _products(asked[row], vectors[place].T), ids[place]
            reach = (scores >= best.floor[row][:, None]) & (other != own[row][:, None])
            if scores.dtype != object and len(place) > 2 * best.most:
                # One more than asked for, as a query may meet itself.
                reach &= scores >= np.partition(scores, -best.most - 1, axis=1)[:, -best.most - 1, None]
            q, c = np.nonzero(reach)
            best.add(row[q], other[c], scores[q, c])


def top_products(vectors: DataFrame, *, top: int = TOP, every: int = EVERY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the `top` rows of
    other vec_ids with the highest inner products of components times SCALE rounded down.

    Ties go to the smaller vec_id. Rows with a null vec_id, a null vector, or null or non-finite components
    take no part; a score too large for a long is null, in its right place; of vectors of unequal length the shorter one ends in
    zeros. A vec_id that repeats is a candidate once for each row but one query only, its first by
    components. Fewer candidates than `top` give fewer rows, an empty table none.

    Shards are of about `shard_rows` vectors at any size. Queries travel in blocks, once for each shard:
    their set grows with the table, hence so does the work for each vector.
    """
    rows = whole_vectors(vectors, SCALE, "vec_id").filter("vec_id is not null")
    shards = max(1, -(-rows.count() // shard_rows))

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"shard": frame.shard[:1].tolist(), "tree": [build(frame.vec_id.to_numpy(), _matrix(frame.v.tolist()))]})

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        return pd.DataFrame({"block": frame.block[:1].tolist(), "queries": [_packed(ids=frame.vec_id.to_numpy(), vectors=_matrix(frame.v.tolist()))]})

    trees = (
        rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
        .repartition(shards, "shard").groupBy("shard").applyInPandas(tree, "shard int, tree binary")
    )
    blocks = max(1, -(-shards * shard_rows // every // BLOCK_ROWS))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("block").applyInPandas(block, "block int, queries binary")
    met = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, "shard")
    met = met.repartition(blocks, "block").sortWithinPartitions("block", "shard")
    names = ["query_id", "rank", "vec_id", "score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, queries, best = None, None, None, None

        def given() -> Iterator[pa.RecordBatch]:
            if best is not None:
                rank = np.arange(len(best.row)) - np.searchsorted(best.row, best.row) + 1
                columns = [pa.array(ids[best.row]), pa.array(rank.astype(np.int32)), pa.array(best.ids), longs(best.scores)]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for key, packed, tree_of in zip(*(batch.column(c) for c in range(3)), strict=True):
                if key.as_py() != now:
                    yield from given()
                    asks = np.load(io.BytesIO(packed.as_py()))
                    now, ids, queries = key.as_py(), asks["ids"], asks["vectors"]
                    best = _Best(len(ids), top)
                search(np.load(io.BytesIO(tree_of.as_py())), queries, ids, best)
        yield from given()

    return met.select("block", "queries", "tree").mapInArrow(each, "query_id long, rank int, vec_id long, score long")
