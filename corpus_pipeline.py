"""The corpus pipeline: five stages, each on all that the one before kept, written and read between.

Rows with null ids, texts or sources go through every stage; of rows that repeat an id and a text, the near-duplicate
stage keeps one. Any other columns are carried along, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import decontaminate, mixing, neardup, quality, toxicity
from tapeworks.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Null and wordless texts stay; without toxic labels all stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.with_toxicity(docs, model, only=False)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and blank texts get the mean label; without labels all stay."""
    space = quality.learn(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.with_quality(docs, space, only=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least id, a null id only if all are. A null text is alone in its group."""
    return neardup.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and wordless texts stay; an empty benchmark removes nothing."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mixture; a null source is a source of its own."""
    return mixing.mixed(docs, mixing.TARGETS)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("mixing", mix)]
#: The classifiers can't be told in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
