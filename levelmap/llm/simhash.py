"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code. A fingerprint's two 32-bit halves are each
covered by the Hamming code of length 31 (perfect, covering radius 1) and one free bit. If two
fingerprints differ in at most 3 bits, one of their halves differs in at most 1. One
fingerprint is indexed under the anchor nearest to that half, within the covering radius 1,
and the other meets it there, since each is replicated to all anchors within radius 1 plus 1:
17 for a half. Comparing per anchor therefore loses no pair. Anchors are 2^27 per half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import free, keep, text_bytes, text_of, thrifty
from levelmap.llm.groups import components, near_in_groups
from levelmap.llm.overlap import fingerprint_of, near_copies, shingle_hashes

SHINGLE = 3
DISTANCE = 3


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: majority of the bits of the shingles' XXH64; 0 without words.

    A-Z are lower-cased and words are what ASCII white space separates, as bytes methods do.
    """
    return fingerprint_of(shingle_hashes(text, words_in_shingle))


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row of `docs`; a null text counts as empty, repeated rows stay."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (fingerprint(t.as_py(), words_in_shingle) for t in batch.column(1))
            fp = np.fromiter(values, np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(thrifty(each), "doc_id long, fp long")


def _anchors(x: str, half: int) -> tuple[Column, Column]:
    """The nearest anchor of a 32-bit half, and all anchors within the covering radius plus one."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    body = f"({x} & {(1 << 31) - 1})"
    syndrome = " + ".join(f"((bit_count({body} & {m}L) & 1) << {k})" for k, m in enumerate(masks))
    tag = f"(({x} & {1 << 31}L) | {half << 32}L)"
    nearest = f"({body} ^ if(({syndrome}) = 0, 0L, 1L << (({syndrome}) - 1)))"
    others = (
        f"transform(filter(sequence(1, 31), i -> ({syndrome}) > 0 and i <> ({syndrome}) and i < (i ^ ({syndrome}))),"
        f" i -> {tag} | ({body} ^ (1L << (i - 1)) ^ (1L << ((i ^ ({syndrome})) - 1))))"
    )
    home = f"({tag} | {nearest})"
    return F.expr(home), F.expr(f"concat(array({home}, {home} ^ {1 << 31}L), {others})")


def anchored(fps: DataFrame) -> DataFrame:
    """Entries for comparison per anchor: each fp once as indexed (role 0) and 17 times as probe, for both halves."""
    parts = []
    for half, shift in ((0, 0), (1, 32)):
        x = f"(shiftrightunsigned(fp, {shift}) & {(1 << 32) - 1}L)"
        home, near = _anchors(x, half)
        parts.append(F.array(F.struct(F.lit(0).alias("role"), home.alias("key"))))
        parts.append(F.transform(near, lambda a: F.struct(F.lit(1).alias("role"), a.alias("key"))))
    return fps.select("fp", F.inline(F.concat(*parts))).select("key", "role", F.col("fp").alias("id"), F.col("fp").alias("code"))


def near_duplicates(docs: DataFrame, *, words_in_shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text; other columns are ignored).

    Documents link if their fingerprints differ in `distance` bits or fewer (3 at most, which the
    covering is built for); component_id is the smallest doc_id reachable, itself included. Equal
    fingerprints are compared once. Null or blank texts have fingerprint zero and are linked like
    any other. A null doc_id takes part but names no component unless no other id is in it. An
    empty table gives an empty result.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the covering finds pairs of at most {DISTANCE} differing bits")
    rows = keep(fingerprints(docs, words_in_shingle))
    distinct = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_in_groups(anchored(distinct), distance))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = keep(labelled.join(smallest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def met_by_anchors(sets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): names of sets (id, fp) whose fingerprints differ in `distance` bits or fewer, pairs enough to join them."""
    named = keep(sets.groupBy("fp").agg(F.min("id").alias("a")))
    equal = sets.join(named, "fp").filter("id <> a").select("a", F.col("id").alias("b"))
    near = near_in_groups(anchored(named), distance).withColumnsRenamed({"a": "fp", "b": "fp_b"})
    other = named.withColumnsRenamed({"fp": "fp_b", "a": "b"})
    return equal.union(near.join(named, "fp").join(other, "fp_b").select("a", "b"))


def representatives(docs: DataFrame, *, least: tuple[int, int] | None = None, **options) -> DataFrame:
    """`docs` with one document of each component: that of the smallest doc_id, with the same columns.

    Components are those of near fingerprints or, where `least` is given as numerator and denominator,
    of that Jaccard similarity or more between sets of shingles: near fingerprints of the sets are found under
    their anchors and compared first, then what 64 bits cannot find (`near_copies`).
    Rows that repeat a doc_id are one document, of which the smallest text stays. Rows without a
    doc_id are told apart by their texts and stay only where their component has no id.
    """
    (key,) = free(docs, "_key")
    unnamed = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    found = near_copies(texts, least=least, met=met_by_anchors, **options) if least else near_duplicates(texts, **options)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    rows = keyed.join(kept, key, "left_semi").groupBy(key)
    return rows.agg(F.min_by(F.struct(*docs.columns), text_of()).alias("_row")).select("_row.*")
