"""What the operators share: row identifiers, connected components, and the library's tables in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import BROADCAST_BYTES, materialize, row_numbers, running, scratch, shared_dir, small

__all__ = ["BROADCAST_BYTES", "components", "finished", "materialize", "numbered", "row_numbers", "running", "scratch", "shared_dir", "small", "small_batches", "text_of"]


def finished(df: DataFrame, name: str) -> DataFrame:
    """The result of a query, written, so that the tables that it was made from can go."""
    return materialize(df, name, keep=True)


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """df with a number of each row, the same whenever it is read, so that rows with equal or null ids can be told apart.

    Rows of a plain scan of files are numbered by file and place, which are added as __file and __at, and nothing is written;
    others are written once with their numbers.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.children().isEmpty() and df.inputFiles():
        at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        names = sorted(r[0] for r in at.select("__file").distinct().collect())  # file names, which the driver's scan lists too
        if names:
            files = df.sparkSession.createDataFrame([(f, i << 36) for i, f in enumerate(names)], "__file string, __first long")
            return at.join(small(files, 300, len(names)), "__file").withColumn(name, F.col("__first") + F.col("__at")).select(*df.columns, name, "__file", "__at")
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered", keep=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs within it passes at most so many rows at once between the JVM and Python, so that whole texts don't pile up in either."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (u, v): returns (node, component), component being the smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder. Minima are partial
    aggregates in tables of their own, so that the joins are plain ones that broadcast if small or that adaptive execution
    splits; a hub costs no single task.
    Nodes without links don't occur in the result. Repeated links, both directions and self-links are allowed.
    """
    e = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links"
    )
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(small(low, 24), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        star = large.join(small(low, 24), "u")
        e = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialize(e.where("u > v").distinct(), "small-star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
