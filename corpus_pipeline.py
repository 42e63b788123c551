"""A training corpus from raw documents, stage by stage; each stage reads the table that the one before it wrote.

All stages but the last return the columns of documents. Rows are whole documents; copies that the mix takes are rows.
Stages that drop or repeat rows number the rows of their input first, and decide by these numbers, so that rows with equal or
null ids, and equal rows, are told apart.

Defined results: a null text has no language and goes in the first stage; given to a later stage, it counts as empty in exact
dedup and packing, is kept as it is by near dedup, and is not taken by the mix; rows that share an id are rows of their own;
repeated rows are copies of each other; an empty table stays empty; extra columns are kept up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm import exact_dedup, language, mixing, near_dedup, packing
from allelix.llm.common import finished, numbered, scratch, shared_dir, small
from allelix.llm.queries import vocabulary

ROW = "__row"


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows (with ROW) whose numbers aren't in gone (row), a written table."""
    return rows.join(small(gone.select(F.col("row").alias(ROW)), 16), ROW, "leftanti").select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: null texts and texts without a letter."""
    told = language.predict(docs, language.fit(docs), "__lang_pred", "__score")
    return told.where("__lang_pred <> 'und'").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id."""
    rows = numbered(docs, ROW)
    with scratch(spark):
        gone = finished(exact_dedup.exact_dedup(rows, row_col=ROW).where("not kept").select("row"), "exact")
    return _without(rows, gone, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    rows = numbered(docs, ROW)
    with scratch(spark):
        gone = finished(near_dedup.near_groups(rows, row_col=ROW).where("not kept").select("row"), "near")
    return _without(rows, gone, docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes it; documents that it doesn't take go."""
    rows = numbered(docs, ROW)
    with scratch(spark):
        told = mixing.mix(rows, row_col=ROW).where("copies > 0").select(F.col("row").alias(ROW), F.col("copies").alias("__copies"))
        told = finished(told, "mix")
    taken = rows.join(small(told, 24), ROW).withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    with scratch(spark):
        return finished(packing.pack(docs, vocabulary()), "pack")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Learned, random and tokenizer-bound stages have no SQL; tests/llm/test_pipeline.py holds each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}", keep=True)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
