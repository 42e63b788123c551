"""Tables in the shared folder, size-checked broadcasts, and ranks over a whole table without a single task."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times its bytes per row stay under this.
BROADCAST_BYTES = 8 << 20

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where that is unset, a local master (one process) gets a temporary folder and any other master the warehouse, which
    executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="allelix-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/allelix/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None and not keep:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the shared folders made within it but those made with keep."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in made:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bytes_per_row: int, rows: int | None = None) -> DataFrame:
    """Mark df for broadcast if its counted rows fit BROADCAST_BYTES; else leave the join to a shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * bytes_per_row <= BROADCAST_BYTES else df


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each of sums, the sum over all rows up to and with this one in the given order.

    Rows are dealt into ranges of the order and written once; each range sums its own rows, and the totals of the ranges
    before it (one row a range) are added by a broadcast join. Ties are summed in any order, one after the other.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    total = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, bounded by the number of tasks
    offsets = total.select("__range", *[F.sum(f"__{name}").over(before).alias(f"__{name}") for name in sums])
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = ranged.select("*", *[F.sum(c).over(own).alias(f"__own_{name}") for name, c in sums.items()]).join(F.broadcast(offsets), "__range")
    for name in sums:
        told = told.withColumn(name, F.col(f"__own_{name}") + F.coalesce(F.col(f"__{name}"), F.lit(0)))
    return told.drop("__range", *[f"__own_{name}" for name in sums], *[f"__{name}" for name in sums])


def row_numbers(df: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """df with its place (from 1) in the given order over the whole table."""
    return running(df, order, {name: F.lit(1).cast("long")})
