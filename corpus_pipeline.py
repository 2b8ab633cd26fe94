"""The training-data pipeline over ``documents``: quality, exact copies, near copies, mixture, packing.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns they were given.  Filtering stages name the rows
that stay by row id, so repeated rows and null ids are told apart.

Defined cases, in every stage: a null text is an empty one; a null doc_id is kept and comes last where the
smallest id stays; repeated rows are copies of each other (one stays in the stages that drop copies, each is
used and packed in the others); texts of any length are read whole; an empty table gives no rows;
further columns, whatever their names, pass through unchanged up to packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, mixing, near_dup, packing, quality


def _only_kept(docs: DataFrame, name: str, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that ``judge(docs, row_id)`` keeps.  Its tables go as soon as the ids of the kept rows are written; the
    result reads the numbered documents and those ids.  What earlier stages wrote goes if nothing reads it any more."""
    common.delete_unused_tables(docs.sparkSession)
    docs, row_id = common.numbered(docs, name)
    with common.recorded() as tables:
        kept = judge(docs, row_id).where("kept").select(F.col("row_id").alias(row_id))
        written = common.materialise(kept, f"{name}-kept", keep=True)
    common.delete_tables(docs.sparkSession, tables)
    return docs.join(written, row_id, "left_semi").drop(row_id)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores at least ``quality.THRESHOLD``; it trains on the labelled rows."""
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model, F.col("text")) >= quality.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _only_kept(docs, "exact-stage", lambda d, row_id: exact_dedup.group_equal_texts(d, row_id=row_id))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return _only_kept(docs, "near-stage", lambda d, row_id: near_dup.join(d, row_id=row_id))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources repeated to the mixture's weights; none is dropped."""
    common.delete_unused_tables(spark)
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document (each use of it) in token sequences, in the order of the mixture's blocks."""
    common.delete_unused_tables(spark)
    return packing.pack(docs, in_order=True)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dup", near_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: The hashes, the trained model and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again.  Once it is written, what the stage and
    the stage before it wrote goes: those tables belong to this run alone."""
    docs = common.read(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with common.recorded() as tables:
            out = stage(spark, docs, sf_dir)
        with common.recorded() as result:
            docs = common.materialise(out, f"stage-{name}")
        common.delete_tables(spark, tables + before)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
