"""Product codes of vectors, their codebooks trained by Lloyd's rounds over cover trees.

Vectors are cut into parts, and every part position has a codebook. A task reads its vectors in chunks
and builds a cover tree for each part position of a chunk; trees are written once and serve all rounds.
A node stands for a run of parts around its centre: its children's centres are further than half its
radius from each other and cover its run within that half, the first child keeping the node's own centre.
Running sums along the tree's order give the sum of any run at once.

A round takes the trees level by level. With r a node's radius, an entry whose distance from the centre
exceeds the least such distance by more than 2 r cannot be the nearest of anything below, by the triangle
inequality. A node that is left with one entry is assigned with its whole run, by its sum and count; only
ambiguous nodes descend, with the entries left to them, and only leaves still ambiguous are compared part by
part, in whole numbers. Bounds carry a margin for rounding, so results are those of the full comparison.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import keep
from levelmap.llm.threshold import FLOOR_DIV
from levelmap.llm.vectors import decimals, exact, in_one_word, long_sum, longs, matrix, whole_vectors

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
CHUNK = 4096
LEAF = 16
_SLICE = 1024
_NODE = ["first", "end", "child", "children"]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of one to every row of the other."""
    out = np.zeros((len(a), len(b)), a.dtype)
    for d in range(a.shape[1]):
        out += (a[:, d, None] - b[None, :, d]) ** 2
    return out


def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree: the points' order, and for each node, a level after the other, its run as places in that
    order, its radius, and where its children stand. A run begins with its centre, or a copy of it, and so
    does every order that its children bring it into."""
    order = np.arange(len(points))
    nodes, radius, at = [[0, len(points), 0, 0]], [], 0
    gaps = [((points - points[0]) ** 2).sum(1)]
    while at < len(nodes):
        node, gap = nodes[at], gaps[at]
        gaps[at] = None
        first, end, _, _ = node
        reach = int(gap.max(initial=0))
        radius.append(reach)
        if reach and end - first > LEAF:
            run = order[first:end]
            own = points[run]
            nearest, group, far = gap.copy(), np.zeros(len(run), np.int64), [gap]
            while 4 * int(nearest.max()) > reach:
                # The point furthest from all centres is the next one.
                far.append(((own - own[nearest.argmax()]) ** 2).sum(1))
                closer = far[-1] < nearest
                nearest[closer], group[closer] = far[-1][closer], len(far) - 1
            sorted_run = np.lexsort((nearest, group))
            order[first:end] = run[sorted_run]
            nearest = nearest[sorted_run]
            ends = np.cumsum(np.bincount(group, minlength=len(far)))
            node[2:] = [len(nodes), len(far)]
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                gaps.append(nearest[lo:hi])
                nodes.append([first + lo, first + hi, 0, 0])
        at += 1
    table = np.array(nodes, np.int32).reshape(-1, len(_NODE))
    return {"order": order.astype(np.int32), "radius": np.array(radius, np.int64)} | {n: table[:, i] for i, n in enumerate(_NODE)}


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of all runs, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class Assigned:
    """What a walk of one tree settled: whole runs, and single parts of ambiguous leaves."""

    def __init__(self, tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray):
        """`points` are in the tree's order."""
        runs, parts = [], []
        level, allowed = np.zeros(1 if len(points) else 0, np.int64), np.ones((1, len(book)), bool)
        self.compared = 0
        while len(level):
            gap = squares(points[tree["first"][level]], book)
            self.compared += gap.size
            top = np.iinfo(np.int64).max
            gap[~allowed] = top
            best = gap.argmin(1)
            least, reach = np.sqrt(gap[np.arange(len(level)), best]), np.sqrt(tree["radius"][level])
            bound = (least + 2 * reach) * (1 + 1e-9) + 1e-6
            allowed = allowed & (np.sqrt(gap) <= bound[:, None])
            whole = (allowed.sum(1) == 1) | (tree["radius"][level] == 0)
            first, size = tree["first"][level], tree["end"][level] - tree["first"][level]
            runs.append((first[whole], size[whole], best[whole]))
            inner = tree["children"][level] > 0
            leaf = ~whole & ~inner
            if leaf.any():
                place, may = _runs(first[leaf], size[leaf]), np.repeat(allowed[leaf], size[leaf], 0)
                gap = squares(points[place], book)
                self.compared += int(may.sum())
                gap[~may] = top
                parts.append((place, gap.argmin(1)))
            down = ~whole & inner
            count = tree["children"][level][down]
            level, allowed = _runs(tree["child"][level][down], count), np.repeat(allowed[down], count, 0)
        none = np.empty(0, np.int64)
        self.first, self.size, self.entry = (np.concatenate([none, *(r[i] for r in runs)]) for i in range(3))
        self.place, self.own = (np.concatenate([none, *(p[i] for p in parts)]) for i in range(2))

    def sums(self, points: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the parts of each entry; a run's sum is a difference of two running sums."""
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0)])
        count, total = np.zeros(entries, np.int64), np.zeros((entries, points.shape[1]), np.int64)
        np.add.at(count, self.entry, self.size)
        np.add.at(total, self.entry, running[self.first + self.size] - running[self.first])
        np.add.at(count, self.own, 1)
        np.add.at(total, self.own, points[self.place])
        return count, total

    def entries(self, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[_runs(self.first, self.size)] = np.repeat(self.entry, self.size)
        out[self.place] = self.own
        return out


class _Plain:
    """A part position of a chunk whose squares may leave a long: compared with every entry, without a tree."""

    def __init__(self, points: np.ndarray, book: np.ndarray):
        points, book = points.astype(object), book.astype(object)
        cut = [squares(points[i : i + _SLICE], book).argmin(1) for i in range(0, len(points), _SLICE)]
        self.nearest = np.concatenate([np.empty(0, np.int64), *cut])

    def sums(self, points: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        count, total = np.bincount(self.nearest, minlength=entries), np.zeros((entries, points.shape[1]), object)
        np.add.at(total, self.nearest, points.astype(object))
        return count, total

    def entries(self, size: int) -> np.ndarray:
        return self.nearest


def _packed(points: np.ndarray, parts: int) -> bytes:
    """A chunk as bytes: its vectors, and a tree for each part position if its squares fit a long."""
    for kind in (np.int8, np.int16, np.int32):
        if not points.size or (points.min() >= np.iinfo(kind).min and points.max() <= np.iinfo(kind).max):
            break
    else:
        kind = np.int64
    arrays = {"points": points.astype(kind)}
    if in_one_word(points):
        for i, part in enumerate(np.split(points, parts, axis=1)):
            arrays |= {f"{name}{i}": a for name, a in build(part).items()}
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _walked(data: bytes, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, Assigned | _Plain]]:
    """For each part position of a chunk: its number, order, parts in that order, and what each got."""
    chunk = np.load(io.BytesIO(data))
    points = chunk["points"].astype(np.int64)
    for i, part in enumerate(np.split(points, len(books), axis=1)):
        if f"order{i}" in chunk and in_one_word(part, books[i]):
            tree = {name: chunk[f"{name}{i}"] for name in ("order", "radius", *_NODE)}
            part = part[tree["order"]]
            yield i, tree["order"], part, Assigned(tree, part, books[i])
        else:
            yield i, np.arange(len(part)), part, _Plain(part, books[i])


def grown(rows: DataFrame, width: int, parts: int, *columns: str) -> DataFrame:
    """Chunks of vectors with their trees, and the chunk's `columns` as lists. Narrow: a task cuts its own rows."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                cut = batch.slice(at, CHUNK)
                ends = pa.array([0, cut.num_rows], pa.int32())
                held = [pa.ListArray.from_arrays(ends, cut.column(i)) for i in range(len(columns))]
                tree = pa.array([_packed(matrix(cut.column(len(columns)), width), parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*held, tree], [*columns, "chunk"])

    kinds = [f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in columns]
    return rows.select(*columns, "v").mapInArrow(plant, ", ".join([*kinds, "chunk binary"]))


def moved(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the means, rounded down, of the parts nearest to them; unused ones stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), object), np.zeros((parts, entries, width), object)
        for batch in batches:
            for data in batch.column(0):
                for i, _, points, found in _walked(data.as_py(), books):
                    more, sum_of = found.sums(points, entries)
                    count[i] += more
                    total[i] += sum_of
        cells = [(p, e) for p in range(parts) for e in range(entries) if count[p, e]]
        flat = [total[p, e, d] for p, e in cells for d in range(width)]
        ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in cells], pa.int32()), pa.array([e for _, e in cells], pa.int32()),
                pa.array([int(count[c]) for c in cells], pa.int64()), pa.ListArray.from_arrays(ends, decimals(flat)),
            ],
            ["part", "entry", "n", "total"],
        )

    rows = chunks.select("chunk").mapInArrow(sums, "part int, entry int, n long, total array<decimal(38,0)>")
    added = [F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(width)]
    out = books.copy()
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        out[r.part, r.entry] = [int(r[f"t{d}"]) // int(r.n) for d in range(width)]
    return out


def coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector; the code is the entries' numbers, two hex digits each."""
    fields = [chunks.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (batch.column(i).slice(row, 1).flatten() for i in range(2))
                codes, error = np.zeros((len(ids), len(books)), np.uint8), 0
                for i, order, points, found in _walked(batch.column(2)[row].as_py(), books):
                    entry = found.entries(len(points))
                    points, near = exact(points, books[i])
                    codes[order, i] = entry
                    off = np.zeros(len(ids), points.dtype)
                    off[order] = ((points - near[entry]) ** 2).sum(1)
                    error = error + off
                texts = pa.array([c.tobytes().hex() for c in codes], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, texts, longs(error)], ["vec_id", "label", "code", "error"])

    return chunks.select("vec_id", "label", "chunk").mapInArrow(code, f"vec_id {fields[0]}, label {fields[1]}, code string, error long")


def codes(
    vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each vector of finite components, and the codebooks (part, entry, position).

    Components are scaled and rounded down. Rows whose vector is null or holds a null or non-finite component
    take no part. Vectors of unequal length, or of one that `parts` does not divide, end in zeros. Fewer
    vectors than `entries` make smaller codebooks; none make no rows. Repeated ids are rows of their own; first
    entries are those of the smallest ids, equal ids by vector, null ids last. Equal entries keep their
    numbers, of which the smaller is used. An error too large for a long is null. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart at most")
    rows = keep(whole_vectors(vectors, scale, "vec_id", "label"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r.v)] = r.v
    books = np.stack(np.split(start, parts, axis=1))
    chunks = keep(grown(rows, width, parts, "vec_id", "label"))
    for _ in range(rounds if first else 0):
        books = moved(chunks, books)
    return coded(chunks, books), books


def digests(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each row of `codes`.

    `label_error` is the sum of errors over equal labels, nulls being equal; null if one of them is.
    """
    rows, books = codes(vectors, **options)
    rows = keep(rows)
    # One row for each label, summed before it moves; written, so that the join is chosen by its size.
    sums = keep(rows.groupBy("label").agg(long_sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


_WIDTH = 64 // PARTS
_GAP = " + ".join(f"(p[{d}] - e[{d}]) * (p[{d}] - e[{d}])" for d in range(1, _WIDTH + 1))


def _round_sql(at: int) -> str:
    return f"""
a{at} as materialized (
  select r, part, p, entry, gap from (
    select *, row_number() over (partition by r, part order by gap, entry) as place
    from (select r, x.part, p, entry, {_GAP} as gap from parts x join b{at} using (part))) where place = 1),
b{at + 1} as materialized (
  select part, entry, coalesce(f, e) as e from b{at} left join (
    select part, entry, list(f order by d) as f from (
      select part, entry, d, {FLOOR_DIV} as f from (
        select part, entry, d, sum(p[d])::hugeint as total, count(*) as n
        from a{at}, range(1, {_WIDTH + 1}) t(d) group by part, entry, d))
    group by part, entry) using (part, entry))"""


#: For vectors of 64 components.
CODES_SQL = f"""
with x as materialized (
  select row_number() over (order by vec_id, v) as r, vec_id, label, v
  from (select vec_id, label, [floor({SCALE} * e::double)::bigint for e in embedding] as v
        from embeddings where embedding is not null and len([e for e in embedding if e is null or not isfinite(e)]) = 0)),
parts as materialized (
  select r, part, v[part * {_WIDTH} + 1:part * {_WIDTH} + {_WIDTH}] as p from x, range({PARTS}) t(part)),
b0 as materialized (select part, r - 1 as entry, p as e from parts where r <= {ENTRIES}),
{",".join(_round_sql(i) for i in range(ROUNDS + 1))},
coded as (select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(gap)::bigint as error from a{ROUNDS} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) from b{ROUNDS}) as codebooks_sha256
from coded join x using (r)
"""
