"""Incremental merge of new calls into a stored table by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import merge_calls


def merge_stream(spark: SparkSession, source: str, table: str, checkpoint: str, schema: str = "taxon_id int, site_id int, a1 int, a2 int"):
    """Every file that arrives in source is merged into a new version folder of table; a call that isn't missing wins over the stored one. Each batch writes its own version, so a repeated batch gives the same one."""

    def merge(batch: DataFrame, epoch: int) -> None:
        old = spark.read.schema(schema).parquet(f"{table}/v={epoch - 1}") if epoch else None
        new = merge_calls(*([old] if old is not None else []), batch)
        new.write.mode("overwrite").parquet(f"{table}/v={epoch}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
