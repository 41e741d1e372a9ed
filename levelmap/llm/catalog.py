"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from levelmap.llm import (
    covertree, lines, mincut, mixture, packing, quality, simhash, threshold, topk, toxicity, urlrules, video, winnow,
)
from levelmap.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.digests(video.store(read(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(read(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(read(spark, sf_dir, "documents")).drop("ids")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read(spark, sf_dir, "embeddings"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read(spark, sf_dir, "pages"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.clusters(read(spark, sf_dir, "embeddings"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.digests(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_video, op2_quality, op3_line_dedup, op4_simhash, op5_main_text,
        op6_toxicity, op7_packing, op8_topk, op9_mixture, op10_url_filter,
        op11_clusters, op12_decontaminate, op13_codes,
    )
}

TOPK_SQL = f"""
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::double)) as v
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.vec_id % {topk.EVERY} = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= {topk.TOP}
"""

ORACLE_SQL = {
    "op8_topk": TOPK_SQL,
    "op9_mixture": mixture.MIX_SQL.format(documents="documents"),
    "op11_clusters": threshold.CLUSTERS_SQL,
    "op12_decontaminate": winnow.LEAKS_SQL,
    "op13_codes": covertree.CODES_SQL,
}
