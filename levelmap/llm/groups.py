"""Comparisons within groups of a shuffle, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import discard, keep, thrifty

CELLS = 1 << 21


def meetings(batch: pa.RecordBatch, state: list, note: Callable[[_Held], None] | None = None) -> Iterator[tuple[_Held, int, int]]:
    """The keys of a batch (key, role, id, code, sorted by key and role) under which an indexed entry may meet
    a probe of another id: what is held of the key, this batch's indexed entries included, and from
    where to where its probes lie. `state` carries an open key and its entries from batch to batch;
    `note` is told when entries were added, whose places are `fresh`."""
    key, role, ids, code = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "role", "id", "code"))
    if not len(key):
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    indexed = np.add.reduceat((role == 0).astype(np.int64), starts)
    others = np.add.reduceat((ids != np.repeat(ids[starts], ends - starts)).astype(np.int64), starts)
    # Alone with its own probes and copies, an entry has no partner.
    busy = (indexed > 0) & (others > 0)
    busy[0] = busy[-1] = True
    for s in np.flatnonzero(busy).tolist():
        lo, hi, cut = int(starts[s]), int(ends[s]), int(starts[s] + indexed[s])
        if key[lo] != state[0]:
            state[:] = key[lo], _Held()
        state[1].add(ids[lo:cut], code[lo:cut], np.arange(lo, cut))
        if note:
            note(state[1])
        if len(state[1].ids) and cut < hi:
            yield state[1], cut, hi


def near_in_groups(rows: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of ids that meet under a key and whose codes differ in `limit` bits or fewer.

    `rows` has key long, role int, id long, code long: role 0 is an indexed entry, 1 a probe; a
    pair is one indexed entry and one probe of different ids. Rows are shuffled by key and
    sorted, then compared in blocks as they stream by: a task holds the indexed ids of one key
    and never a whole group. A key yields no more pairs than it has rows, still
    joining the same ids: those that link sets which the key's earlier pairs left apart.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [None, None]
        for batch in batches:
            ids, code = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "code"))
            found = [pairs for held, lo, hi in meetings(batch, state) for pairs in held.links(ids[lo:hi], code[lo:hi], limit)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _by_key(rows).mapInArrow(thrifty(compare), "a long, b long")


def with_partners(rows: DataFrame, limit: int) -> DataFrame:
    """The `rows` (see `near_in_groups`) that have a partner under their key, each once for every batch it is in."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [None, None]
        for batch in batches:
            key, ids, code = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "id", "code"))
            for held, lo, hi in meetings(batch, state):
                own, at = held.partners(ids[lo:hi], code[lo:hi], limit)
                if len(own):
                    columns = (
                        np.full(len(own) + len(at), key[lo]),
                        np.repeat(np.array([1, 0], np.int32), [len(own), len(at)]),
                        np.r_[ids[lo + own], held.ids[at]],
                        np.r_[code[lo + own], held.codes[at]],
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "role", "id", "code"])

    return _by_key(rows).mapInArrow(thrifty(compare), "key long, role int, id long, code long")


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.select("key", "role", "id", "code").repartition("key").sortWithinPartitions("key", "role")


class _Held:
    """The indexed entries of one key, each id once, and which of them its pairs have joined so far."""

    def __init__(self) -> None:
        self.ids, self.codes, self.label = (np.empty(0, np.int64) for _ in range(3))
        self.met, self.fresh = np.empty(0, bool), np.empty(0, np.int64)
        self.about: list = []

    def add(self, ids: np.ndarray, codes: np.ndarray, places: np.ndarray) -> None:
        """Adds entries; `fresh` then has the places of those that were not held yet."""
        at = np.unique(ids, return_index=True)[1]
        at = at[~np.isin(ids[at], self.ids)]
        n = len(self.ids)
        self.ids, self.codes, self.fresh = np.r_[self.ids, ids[at]], np.r_[self.codes, codes[at]], places[at]
        self.label = np.r_[self.label, np.arange(n, n + len(at))]
        self.met = np.r_[self.met, np.zeros(len(at), bool)]

    def near(self, ids: np.ndarray, codes: np.ndarray, limit: int, cells: int) -> Iterator[tuple[int, np.ndarray]]:
        """From which probe on, and for some probes by all entries, whether the two differ little."""
        step = max(1, cells // len(self.ids))
        for lo in range(0, len(ids), step):
            own = ids[lo : lo + step]
            near = np.bitwise_count((codes[lo : lo + step, None] ^ self.codes[None, :]).view(np.uint64)) <= limit
            yield lo, near & (own[:, None] != self.ids[None, :])

    def partners(self, ids: np.ndarray, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The probes that are near an entry, and the entries that are near a probe for the first time."""
        own, before = [np.empty(0, np.int64)], self.met.copy()
        for lo, near in self.near(ids, codes, limit, CELLS):
            own.append(lo + np.flatnonzero(near.any(1)))
            self.met |= near.any(0)
        return np.concatenate(own), np.flatnonzero(self.met & ~before)

    def links(self, ids, codes, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for lo, near in self.near(ids, codes, limit, CELLS):
            row, col = np.nonzero(near)
            if len(row):
                row, col = self.joining(row, col)
                out.append((ids[lo + row], self.ids[col]))
        return out

    def joining(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each probe one pair into every set of entries that it touches; then these are one set."""
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rows, cols = [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
            sets, at = np.unique(self.label[col[lo:hi]], return_index=True)
            rows += [row[lo]] * len(sets)
            cols += col[lo + at].tolist()
            if len(sets) > 1:
                self.label[np.isin(self.label, sets)] = sets[0]
        return np.array(rows), np.array(cols)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the connected components of links (a long, b long), without collecting any.

    Every round replaces each node by the smallest node it is linked with and drops links that
    have become loops. Ids are hashes, so a good share of the nodes goes in each round. Minima
    are combined before the shuffle and the joins are plain equi-joins, which Spark splits
    where one node has very many links. Roots name components and have no other meaning.
    """
    both = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct()
    both = keep(both)
    roots = keep(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not both.isEmpty():
        least = keep(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        before = roots, both, least
        roots = keep(
            roots.join(least, F.col("root") == F.col("a"), "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        left = both.join(least, "a").select(F.col("to").alias("a"), "b")
        moved = left.join(least.withColumnsRenamed({"a": "b", "to": "to_b"}), "b").select("a", F.col("to_b").alias("b"))
        both = keep(moved.filter("a <> b").distinct())
        discard(*before)
    discard(both)
    return roots
