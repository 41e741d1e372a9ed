"""Clusters around centroids, each vector's nearest one found by the threshold algorithm.

Every dimension has the centroids as a list sorted by value. A vector enters each list at its own value
and walks outward, one centroid per list and round, the nearer side first. A centroid met for the first
time gets its exact distance. What no list has shown yet is at least as far as the lists' frontiers
together, so a vector stops once the sum of its squared frontier distances strictly exceeds its best
exact distance; at equality the walk goes on, and ties go to the smaller number. All vectors of a slice
walk in step.

The centroids, `clusters` times `width` numbers, are all that a round sends out or returns; vectors stay
where they were written. A task sums its own vectors, so a cluster of any size is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import keep
from levelmap.llm.vectors import decimals, exact, long_sum, longs, matrix, whole_vectors

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
_SLICE = 2048


class Lists:
    """The sorted lists of some centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each row."""
        parts = [self._walk(x[at : at + _SLICE]) for at in range(0, len(x), _SLICE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, width = self.centroids.shape
        dims, far = np.arange(width), 1 << 62
        far = far if x.dtype != object else far << 128
        right = np.stack([np.searchsorted(self.values[:, d], x[:, d]) for d in dims], 1) if width else np.zeros(x.shape, np.int64)
        left = right - 1
        seen = np.zeros((len(x), k), bool)
        best, number = np.full(len(x), far, x.dtype), np.full(len(x), k)
        if not width:
            return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        walking = np.arange(len(x))
        while len(walking):
            own, lo, hi = x[walking], left[walking], right[walking]
            down = np.where(lo >= 0, own - self.values[np.maximum(lo, 0), dims], far)
            up = np.where(hi < k, self.values[np.minimum(hi, k - 1), dims] - own, far)
            lower = down <= up
            met = np.zeros((len(walking), k), bool)
            met[np.arange(len(walking))[:, None], self.order[np.where(lower, lo, hi), dims]] = True
            met &= ~seen[walking]
            seen[walking] |= met
            row, c = np.nonzero(met)
            distance = np.full(met.shape, far, x.dtype)
            distance[row, c] = ((own[row] - self.centroids[c]) ** 2).sum(1)
            nearest = distance.argmin(1)
            least = distance[np.arange(len(walking)), nearest]
            better = (least < best[walking]) | (least == best[walking]) & (nearest < number[walking])
            best[walking[better]], number[walking[better]] = least[better], nearest[better]
            left[walking], right[walking] = lo - lower, hi + ~lower
            frontier = (np.where(lower, down, up) ** 2).sum(1)
            walking = walking[(frontier <= best[walking]) & ~seen[walking].all(1)]
        return number, best


def starts(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids, at most `clusters` of them; a null id comes last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in rows.orderBy(key.asc_nulls_last(), "v").limit(clusters).collect()], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the means, rounded down, of the vectors nearest to them; those of none stay."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, np.zeros((k, width), object)
        for batch in batches:
            x, c = exact(matrix(batch.column(0), width), centroids)
            number, _ = Lists(c).nearest(x) if len(x) else ([], [])
            for i in np.unique(number).tolist():
                own = x[number == i]
                count[i] += len(own)
                total[i] += own.sum(0)
        held = [i for i in range(k) if count[i]]
        cells = [(i, d) for i in held for d in range(width)]
        columns = [[i for i, _ in cells], [d for _, d in cells], [count[i] for i, _ in cells]]
        columns = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, decimals(total[i, d] for i, d in cells)], ["cluster", "at", "n", "total"])

    parts = rows.select("v").mapInArrow(sums, "cluster int, at int, n long, total decimal(38,0)")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.cluster, r.at] = int(r.total) // int(r.n)
    return out


def nearest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = exact(matrix(batch.column(1), width), centroids)
                number, distance = Lists(c).nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(number.astype(np.int32)), longs(distance)], ["vec_id", "cluster", "distance"]
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def clusters(
    vectors: DataFrame, *, width: int = WIDTH, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `width` finite components.

    Components are scaled and rounded down. Other vectors take no part, nor are other columns read. Fewer
    vectors than `clusters` are a centroid each at first; an empty table gives no rows. Repeated ids are rows of
    their own; of equal hashes the lesser vector comes first, and a null id comes after all others. Equal
    centroids keep their numbers, of which the smaller gets the vectors. Distances and sums are exact; one
    that is too large for a long is null, as are sums over it.
    """
    rows = keep(whole_vectors(vectors, scale, "vec_id", width=width))
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        return rows.selectExpr(
            "vec_id", "int(null) as cluster", "bigint(null) as distance", "bigint(null) as cluster_inertia",
            "bigint(null) as inertia", "string(null) as centroid_sha256",
        )
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    assigned = keep(nearest(rows, centroids))
    # One row for each cluster from here on.
    inertia = [(r.cluster, r.total) for r in assigned.groupBy("cluster").agg(long_sum("distance").alias("total")).collect()]
    whole = None if any(t is None for _, t in inertia) or sum(t for _, t in inertia) >= 1 << 63 else sum(t for _, t in inertia)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = rows.sparkSession.createDataFrame(
        [(c, t, whole, names[c]) for c, t in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


_DISTANCE = "list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, len(v) + 1)])"
FLOOR_DIV = "((total - ((total % n) + n) % n) // n)::bigint"


def _round_sql(at: int) -> str:
    return f"""
a{at} as materialized (
  select r, vec_id, v, cluster, distance from (
    select *, row_number() over (partition by r order by distance, cluster) as place
    from (select x.*, cluster, {_DISTANCE}::bigint as distance from x, c{at})) where place = 1),
c{at + 1} as materialized (
  select cluster, coalesce(f, c) as c from c{at} left join (
    select cluster, list(f order by d) as f from (
      select cluster, d, {FLOOR_DIV} as f from (
        select cluster, d, sum(v[d])::hugeint as total, count(*) as n from a{at}, range(1, {WIDTH + 1}) t(d) group by cluster, d))
    group by cluster) using (cluster))"""


CLUSTERS_SQL = f"""
with x as materialized (
  select row_number() over () as r, vec_id, [floor({SCALE} * e::double)::bigint for e in embedding] as v
  from embeddings where embedding is not null and len(embedding) = {WIDTH}
    and len([e for e in embedding if e is null or not isfinite(e)]) = 0),
c0 as materialized (
  select (place - 1)::integer as cluster, v as c
  from (select v, row_number() over (order by sha256('{SEED}:' || vec_id), v) as place from x) where place <= {CLUSTERS}),
{",".join(_round_sql(i) for i in range(ROUNDS + 1))}
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c{ROUNDS}.c, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} using (cluster)
"""
