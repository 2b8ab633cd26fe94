"""The operators' registered queries, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import best_fit, exact_dedup, fim, mixing, near_dup, packing, pii, quality, runs, secrets, suffix_dedup, url_filter, vector_dedup
from tessera.llm.common import read, with_row_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_ngram_jaccard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.join(read(spark, sf_dir, "documents")).drop("row_id")


@register("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("row_id")


@register("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@register("op4_vector_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(read(spark, sf_dir, "embeddings"))


@register("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, row_id = with_row_id(read(spark, sf_dir, "documents"))
    return mixing.plan(docs, row_id).drop("row_id")


@register("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


@register("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op8_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_equal_texts(read(spark, sf_dir, "documents")).drop("row_id")


@register("op9_url_filter", url_filter.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(url_filter.fetches(pages), url_filter.derived_list(pages))


@register("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@register("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(read(spark, sf_dir, "documents")).drop("row_id")


@register("op12_fill_in_middle", fim.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.apply(read(spark, sf_dir, "documents")))


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summarise(runs.find(read(spark, sf_dir, "documents"), repeated=True))
