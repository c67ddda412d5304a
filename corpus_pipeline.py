"""From raw documents to a training mix, in five stages that each write what they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crewmetrics.llm import language, mixing, near_dups, pu_quality, suffixes
from crewmetrics.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("quality classifier", quality),
    ("language", languages),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs


#: The learnt stages have no SQL; tests hold the pipeline against a version that knows no Spark.
ORACLE_SQL = None
