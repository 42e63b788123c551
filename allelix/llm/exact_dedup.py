"""Exact deduplication as a stateful stream over a store that can be reopened.

Arrivals are landed as narrow rows (id, digest, content locator); a streaming aggregation keyed by the digest keeps,
in a disk-backed state store without expiry, the largest identifier with its locator and the number of copies. Rows
that hit a digest more than once are checked by their full bytes, which are read at their locators: file and row in
the Parquet files that they came from, or in the store's own `content` folder where the arrivals don't come straight from
files. Texts that share a digest and differ are told apart by the texts themselves. Only built-in functions run on the
executors. Everything lies under one root, so another process can open it and go on.

Defined results: a null text counts as empty; null ids count as smallest; of rows with equal text and equal id the one that
arrived last stays; an empty table gives an empty result; other columns are ignored, whatever their names. More arrivals can be
ingested at any time. If a located text no longer has its digest the check raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import materialize, shared_dir, small, text_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVAL = "doc_id long, digest string, text_sha256 string, file string, row long, seq long, ingest int, row_id long"
SOURCE = "ingest int, text_col string, path string"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class ExactDedup:
    """digest may be any expression of the text; a weak one costs only more full comparisons. root: an existing store or a new one.

    from_files: whether id_col and text_col are stored columns of the Parquet files that the arrivals are read from; with
    False (a text that is computed) the texts are copied into the store.
    """

    def __init__(self, spark: SparkSession, digest=sha256, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, row_col: str | None = None, from_files: bool = True):
        self.spark, self.digest, self.id_col, self.text_col, self.row_col, self.from_files = spark, digest, id_col, text_col, row_col, from_files
        self.root = root or shared_dir(spark, "exact-dedup")

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _sources(self) -> DataFrame:
        """A row for each file that arrivals were read from: names only."""
        return self.spark.read.schema(SOURCE).parquet(f"{self.root}/sources")

    def _next(self) -> int:
        """The number of the next arrival; a lost run has used up its own."""
        return 1 + (self._sources().agg(F.max("ingest")).first()[0] or 0) if self._exists("sources") else 1

    def _own_content(self, docs: DataFrame, at: int) -> DataFrame:
        docs.select(self.id_col, self.text_col, *([self.row_col] if self.row_col else [])).write.parquet(f"{self.root}/content/{at}")
        return self.spark.read.parquet(f"{self.root}/content/{at}")

    def ingest(self, docs: DataFrame) -> ExactDedup:
        """Land the arrivals and bring the state up to date."""
        at, given = self._next(), docs
        told = ("__file", "__at")  # by common.numbered
        place = lambda df: told if set(told) <= set(df.columns) else ("_metadata.file_path", "_metadata.row_index")
        locate = lambda df: df.select(
            F.col(self.id_col).cast("long").alias("doc_id"), text_of(self.text_col).alias("text"), F.col(place(df)[0]).alias("file"), F.col(place(df)[1]).alias("row"),
            (F.col(self.row_col).cast("long") if self.row_col else F.lit(None).cast("long")).alias("row_id"),
        )
        try:
            located = locate(docs) if self.from_files else None
        except AnalysisException:  # not read from files
            located = None
        if located is None:
            given = self._own_content(docs, at)
            located = locate(given)
        files = [(at, self.text_col, f) for f in given.inputFiles()] or [(at, self.text_col, None)]
        self.spark.createDataFrame(files, SOURCE).coalesce(1).write.mode("append").parquet(f"{self.root}/sources")
        located.select(
            "doc_id", self.digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256"), "file", "row",
            F.monotonically_increasing_id().alias("seq"), F.lit(at).alias("ingest"), "row_id",
        ).write.mode("append").parquet(f"{self.root}/arrivals")
        self._advance()
        return self

    def _advance(self) -> None:
        # Executors close the stores of a query that has ended, and free their disk, at their next maintenance.
        # Without preallocation a store takes the disk of its keys, not some 4 MB however few they are.
        wanted = {"providerClass": ROCKS, "maintenanceInterval": "5s", "rocksdb.allowFAllocate": "false"}
        conf, wanted = self.spark.conf, {f"spark.sql.streaming.stateStore.{k}": v for k, v in wanted.items()}
        before = {k: conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, v)
        try:
            arrivals = self.spark.readStream.schema(ARRIVAL).parquet(f"{self.root}/arrivals")
            state = arrivals.groupBy("digest").agg(
                F.max(F.struct("doc_id", "ingest", "seq", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")
            )
            query = (
                state.writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True)
                .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{self.root}/state/epoch={epoch}")).start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def state(self) -> DataFrame:
        """Digest, the struct of the row that stays with its locator, number of copies."""
        schema = "digest string, keep struct<doc_id:long,ingest:int,seq:long,file:string,row:long>, n long, epoch int"
        if not self._exists("state"):
            return self.spark.createDataFrame([], schema).drop("epoch")
        changes = self.spark.read.schema(schema).parquet(f"{self.root}/state")
        if self._exists("state/epoch=0") and not self._exists("state/epoch=1"):
            return changes.drop("epoch")
        return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "epoch").alias("s")).select("digest", "s.keep", "s.n")

    def contents(self, rows: DataFrame) -> DataFrame:
        """rows (file, row, digest and others) with the text at their locators; columns are read, pruned, from the files that hold them."""
        parts = []
        for name in [r[0] for r in self._sources().select("text_col").distinct().collect()]:
            files = [r[0] for r in self._sources().where((F.col("text_col") == name) & F.col("path").isNotNull()).select("path").distinct().collect()]
            if files:
                parts.append(self.spark.read.parquet(*files).select(text_of(name).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        if not parts:
            return rows.withColumn("text", F.lit(None).cast("string")).limit(0)
        texts = parts[0]
        for part in parts[1:]:
            texts = texts.union(part)
        return texts.join(small(rows, 250), ["file", "row"])

    def result(self) -> DataFrame:
        """One row per arrival: doc_id, keep_id, group_size, kept, text_sha256 (and row, if rows were numbered by row_col)."""
        arrivals = self.spark.read.schema(ARRIVAL).parquet(f"{self.root}/arrivals")
        hits = materialize(self.state().where("n > 1"), "hits")
        hits_n = hits.count()
        told = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *([F.col("row_id").alias("row")] if self.row_col else [])]
        joined = self._decide(arrivals, small(hits, 250, hits_n))
        if not hits_n:
            return joined.select(told)
        marks = small(hits.select("digest"), 100, hits_n)
        met = materialize(arrivals.join(marks, "digest", "leftsemi").select("digest", "doc_id", "ingest", "seq", "file", "row", "row_id"), "hit-rows")
        texts = self.contents(met)
        checked = texts.groupBy("digest").agg(
            F.min("text").alias("low"), F.max("text").alias("high"), F.count(F.lit(1)).alias("found"), F.count_if(self.digest(F.col("text")) != F.col("digest")).alias("changed")
        )
        checked = materialize(checked.select("digest", (F.col("low") != F.col("high")).alias("mixed"), "found", "changed"), "checked")
        found, changed = checked.agg(F.sum("found"), F.sum("changed")).first()
        if changed or found != met.count():
            raise ValueError(f"{changed or 0} located texts differ from their digests, {met.count() - (found or 0)} weren't found under {self.root}")
        mixed = checked.where("mixed").select("digest")
        if mixed.isEmpty():
            return joined.select(told)
        # Texts that differ under one digest: their groups are those of the whole texts.
        alike = texts.join(small(mixed, 100), "digest")
        last = F.max(F.struct("doc_id", "ingest", "seq"))
        groups = alike.groupBy("digest", "text").agg(last.alias("keep"), F.count(F.lit(1)).alias("group_size"))
        rows = alike.join(groups, ["digest", "text"])
        kept = F.struct("doc_id", "ingest", "seq") == F.col("keep")
        apart = rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), sha256(F.col("text")).alias("text_sha256"), *told[5:])
        return joined.join(mixed, "digest", "leftanti").select(told).union(apart)

    @staticmethod
    def _decide(arrivals: DataFrame, hits: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("ingest") == F.col("keep.ingest")) & (F.col("seq") == F.col("keep.seq"))
        return arrivals.join(hits, "digest", "left").select(
            "digest", "doc_id", F.when(F.isnull("n"), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.isnull("n") | same).alias("kept"), "text_sha256", "row_id",
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    return ExactDedup(docs.sparkSession, id_col=id_col, text_col=text_col, row_col=row_col).ingest(docs).result()
