"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

The mix is a sequence of slots of equally many words. Slot t lies at the golden-ratio point
frac(t * 0.618...), and the source whose stretch of the cumulated shares holds that point owns
it, so that any run of slots is near the target shares. A source's documents, shuffled and laid
end to end, are cut into blocks of one slot's words; the r-th slot of a source takes its block
r modulo the number of blocks, its last one only up to the target. The points leave a source a
few slots over or short; slots over go, in order, to sources that are short.

There are about `SLOTS` slots at any size of the input, hence one is SLOTS^-1 of all words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelmap.llm.common import free, keep, text_of

SLOTS = 1 << 18
WEIGHTS = (1, 2, 3)
MOST = 3
GOLDEN = 1327217885  # 2^31 divided by the golden ratio, odd
WORDS = r"[^\x20\x09-\x0D]+"
STRETCHES = 4096


def _before(rows: DataFrame, by: str, bucket: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds exclusive running sums per group in the order of (bucket, *order).

    Sums per bucket are cumulated first, so that a window holds one bucket of one group at most.
    """
    totals = rows.groupBy(by, bucket).agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    outer = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(by, bucket, *(F.coalesce(F.sum(f"_{k}").over(outer), F.lit(0)).alias(f"_{k}") for k in sums))
    added = {k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(inner), F.lit(0)) for k, v in sums.items()}
    return rows.join(before, [by, bucket]).withColumns(added).drop(*(f"_{k}" for k in sums))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_no, source_size, target.

    Sources by code point, null last, weigh `weights` in turn. A target is the source's share of
    all words by weight, at most `most` times its size; with the sources in the order of size over
    weight, the level is the first that leaves the source at hand and all later ones uncapped.
    The windows here run over one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_rows = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("source_no", (F.row_number().over(all_rows) - 1).cast("long"))
    sources = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    capped = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    sources = sources.withColumn("level", (F.sum("source_size").over(whole) - capped) / rest)
    found = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))
    sources = sources.withColumn("level", F.min(found).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return sources.select("source", "source_no", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def plan(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds to each source: block (words of a slot), blocks, quota (words to take), need (slots), and `upto`,
    the slots of all sources up to it."""
    whole = Window.partitionBy()
    running = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    quota = F.floor(F.col("target") + 0.5)
    return (
        sources.withColumn("block", F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(whole) / slots)))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
        .withColumn("quota", quota)
        .withColumn(
            "need",
            F.expr(
                "if(source_size = 0, 0L, quota div source_size * blocks"
                " + (quota % source_size + block - 1) div block)"
            ),
        )
        .withColumn("upto", F.sum("need").over(running))
    )


def schedule(sources: DataFrame, total: int) -> DataFrame:
    """(t, source_no, rank): the owner of each of the `total` slots, and which of its own slots it is."""
    spark = sources.sparkSession
    width = max(1, -(-total // STRETCHES))
    held = sources.filter("need > 0").select("source_no", "need", (F.col("upto") - F.col("need")).alias("lo"), F.col("upto").alias("hi"))
    by_stretch = held.withColumn("stretch", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    points = spark.range(total).select(
        F.col("id").alias("t"), F.expr(f"shiftright(((id * {GOLDEN}L + {GOLDEN // 2}L) % {1 << 31}L) * {total}L, 31)").alias("at")
    )
    points = points.withColumn("stretch", F.expr(f"at div {width}"))
    owned = points.join(by_stretch, "stretch").filter("at >= lo and at < hi").select("t", "source_no", "need")
    owned = owned.withColumn("run", F.expr(f"t div {width}"))
    ranked = keep(_before(owned, "source_no", "run", ["t"], {"rank": F.lit(1)}).select("t", "source_no", "need", "rank"))
    over = ranked.filter("rank >= need").select("t", (F.row_number().over(Window.orderBy("t"))).alias("n"))
    had = ranked.groupBy("source_no").agg(F.count("*").alias("had"))
    short = (
        held.join(had, "source_no", "left")
        .withColumn("had", F.coalesce("had", F.lit(0)))
        .filter("had < need")
        .select("source_no", F.explode(F.expr("sequence(had, need - 1)")).alias("rank"))
        .withColumn("n", F.row_number().over(Window.orderBy("source_no", "rank")))
    )
    moved = over.join(short, "n").select("t", "source_no", "rank")
    return ranked.filter("rank < need").select("t", "source_no", "rank").unionByName(moved)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of `docs` (doc_id, text, source).

    Size counts the words of the text; a null or blank text has none and is never taken. The
    order within a source comes from a digest of doc_id, so reruns agree; repeated rows count
    each, and null sources form one source, last. `taken` sums to the source's target, rounded,
    and is at most `most` times the size. An empty table gives an empty result.
    """
    size = F.regexp_count(text_of(), F.lit(WORDS)).cast("long")
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = keep(docs.select("doc_id", "source", size.alias("size"), name.alias("shuffled")))
    sources = keep(plan(targets(sized, weights, most), slots))
    total = sources.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    slot_rows = schedule(sources, total).join(sources.drop("source"), "source_no")
    uses = slot_rows.select(
        "source_no",
        F.expr("rank % blocks").alias("block_no"),
        F.expr("if(rank div blocks < quota div source_size, source_size, quota % source_size)").alias("limit"),
    )
    named = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "block")
    rows = sized.join(named, sized.source.eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.substring("shuffled", 1, 3))
    order = ["shuffled", "doc_id", "size"]
    laid = _before(rows, "source_no", "bucket", order, {"start": F.col("size")})
    order_no = Window.partitionBy("source_no", "bucket").orderBy(*order)
    laid = laid.withColumn("row_no", F.row_number().over(order_no))
    pieces = laid.withColumn(
        "block_no", F.explode_outer(F.expr("if(size > 0, sequence(start div block, (start + size - 1) div block), null)"))
    )
    part = F.expr("least(start + size, (block_no + 1) * block, limit) - greatest(start, block_no * block)")
    return (
        pieces.join(uses, ["source_no", "block_no"], "left")
        .withColumn("words", F.when(F.col("limit").isNotNull(), F.greatest(F.lit(0), part)).otherwise(F.lit(0)))
        .groupBy("source_no", "bucket", "row_no", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum("words").cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken", "source")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`docs` as the mix takes them, with the same columns: a document appears once for each time that its
    words are taken, to the nearest whole, and not at all if fewer than half of them are. Rows that repeat a
    doc_id are one document and appear alike."""
    doc, times, time = free(docs, "_doc", "_times", "_time")
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias(doc)).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    often = taken.filter("2 * _taken >= _size and _taken > 0").select(doc, F.expr("cast(floor(_taken / _size + 0.5) as int)").alias(times))
    joined = docs.join(often, F.col("doc_id").eqNullSafe(F.col(doc)))
    return joined.withColumn(time, F.explode(F.expr(f"sequence(1, {times})"))).select(*docs.columns)


#: The same rule over plain windows, for DuckDB. `{documents}` names the table.
MIX_SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as shuffled
  from {{documents}}),
numbered as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as source_no
  from sized group by source),
weighed as (select *, source_no % 3 + 1 as weight, source_size * {MOST} as cap from numbered),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source_no
      rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by cap / weight, source_no rows between current row and unbounded following))::double as level
  from weighed),
level as (select level from levels where level <= cap / weight order by cap / weight, source_no limit 1),
aimed as (
  select source, source_no, source_size, coalesce(least(cap::double, (select level from level) * weight), 0.0) as target
  from weighed),
blocked as (
  select *, greatest(1, ceil((sum(source_size) over ())::double / {SLOTS}))::bigint as block, floor(target + 0.5)::bigint as quota
  from aimed),
counted as (
  select *, case when source_size = 0 then 0 else quota // source_size end as rounds,
    case when source_size = 0 then 0 else quota % source_size end as over
  from blocked),
laid as (
  select doc_id, size, c.*, (sum(size) over (partition by source_no order by shuffled, doc_id nulls first, size
      rows between unbounded preceding and current row) - size)::bigint as start
  from sized s join counted c on s.source is not distinct from c.source)
select doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(start + size, over) - start))::bigint as taken, source
from laid
"""
