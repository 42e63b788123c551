"""Size-tiered compaction of immutable shards.

Arrivals are appended as small Parquet shards that never change. Compaction groups the live shards into tiers by size
(powers of fan_in under the target size), and a tier that holds fan_in shards or more is rewritten into files of about
the target size; shards that have reached it are left alone. A version lists the live shards and the schema. It is written
whole under a name of its own; then the version's number is claimed by creating a small file that names it, which fails if that
number is taken. So readers see the old or the new version as a whole, and of two writers one wins and the other raises
FileExistsError. (Creation that fails on an existing file is atomic on HDFS and on stores with conditional writes.)
Rewriting is a plain scan without a shuffle; only file names and sizes reach the driver. Data folders have random names, so
that what a lost run left behind blocks nothing. A store can be reopened by its root alone.

Defined results: rows are kept as they are, nulls, repeated rows and all columns included; columns that an arrival adds are
null in earlier rows, and a column whose type changes is refused; an empty arrival adds no shard;
a run that was lost leaves files that no version names and vacuum() removes; a claim that was lost between its creation and
its content is skipped by readers and removed by vacuum().
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import shared_dir


class ShardStore:
    def __init__(self, spark: SparkSession, root: str | None = None, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root or shared_dir(spark, "shards"), target_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        p = self._path(folder)
        if not self._fs.exists(p):
            return []
        return sorted((f"{folder}/{s.getPath().getName()}", s.getLen()) for s in self._fs.listStatus(p) if s.getPath().getName()[0] not in "._")

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Create a file; raises FileExistsError if it exists."""
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "exists" in str(e.java_exception):
                raise FileExistsError(name) from None
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def _claims(self) -> dict[int, int]:
        """{version: bytes} of the claims, those without content included."""
        return {int(n.rsplit("-", 1)[1]): size for n, size in self._names("versions")}

    def version(self) -> int:
        return max([0, *(v for v, size in self._claims().items() if size)])

    def _version(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self._get(self._get(f"versions/v-{version:09d}"))) if version else {"shards": [], "schema": None}

    def shards(self, version: int | None = None) -> list[dict]:
        """[{path, bytes}] of a version, the latest unless given."""
        return self._version(version)["shards"]

    def schema(self, version: int | None = None) -> StructType | None:
        text = self._version(version)["schema"]
        return text and StructType.fromJson(json.loads(text))

    def commit(self, shards: list[dict], after: int, schema: StructType | None = None) -> int:
        """Publish the version that follows `after`; raises FileExistsError if another writer has published it or is about to."""
        schema = schema or self.schema(after)
        manifest = f"manifests/{uuid.uuid4().hex}.json"
        self._put(manifest, json.dumps({"version": after + 1, "shards": shards, "schema": schema and schema.json()}))
        self._put(f"versions/v-{after + 1:09d}", manifest)
        return after + 1

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.root}/{folder}")
        return [{"path": n, "bytes": b} for n, b in self._names(folder) if n.endswith(".parquet")]

    def append(self, df: DataFrame, rows_per_shard: int = 5000) -> int:
        """Each task's rows become shards of at most rows_per_shard rows; columns that the store doesn't know are added to it."""
        at = self.version()
        known = self.schema(at)
        fields = {f.name: f for f in known.fields} if known else {}
        for f in df.schema.fields:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise TypeError(f"{f.name} is {fields[f.name].dataType.simpleString()} in the store, {f.dataType.simpleString()} in the arrival")
            fields.setdefault(f.name, f)
        schema = StructType([StructField(f.name, f.dataType, True, f.metadata) for f in fields.values()])
        return self.commit([*self.shards(at), *self._write(df, rows_per_shard)], at, schema)

    def tier(self, size: int) -> int:
        """0 for shards of half the target and more, else one more for each factor of fan_in below it."""
        t = 0
        while size * 2 < self.target:
            size *= self.fan_in
            t += 1
        return t

    def compact(self) -> int:
        """Merge runs of similar size until no tier but the last holds fan_in shards; returns the version."""
        while True:
            at = self.version()
            live, tiers = self.shards(at), {}
            for s in live:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = [t for t in sorted(tiers, reverse=True) if t and len(tiers[t]) >= self.fan_in]
            if not full:
                return at
            run = tiers[full[0]]
            total = sum(s["bytes"] for s in run)
            files = max(1, min(round(total / self.target), len(run) // 2))
            merged = self._write(self.read_shards(run, at).coalesce(files))
            gone = {s["path"] for s in run}
            self.commit([*(s for s in live if s["path"] not in gone), *merged], at)

    def read_shards(self, shards: list[dict], version: int | None = None) -> DataFrame:
        schema = self.schema(version) or StructType([])
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.read_shards(self.shards(version), version)

    def vacuum(self) -> None:
        """Remove what the latest version doesn't name: data files, manifests, and lost claims. Older versions can't be read afterwards, and no writer may be at work."""
        at = self.version()
        live = {s["path"] for s in self.shards(at)}
        if self._fs.exists(self._path("data")):
            for folder in self._fs.listStatus(self._path("data")):
                name = f"data/{folder.getPath().getName()}"
                files = [n for n, _ in self._names(name)]
                dead = [n for n in files if n not in live]
                for n in dead if len(dead) < len(files) else [name]:
                    self._fs.delete(self._path(n), True)
        manifest = self._get(f"versions/v-{at:09d}") if at else None
        for n, _ in self._names("manifests"):
            if n != manifest:
                self._fs.delete(self._path(n), False)
        for v in self._claims():
            if v != at:
                self._fs.delete(self._path(f"versions/v-{v:09d}"), False)


def shard(docs: DataFrame, target_bytes: int = 32 << 20, rows_per_shard: int = 500) -> DataFrame:
    """Append docs, compact, commit and read back: doc_id, shard, shard_bytes, version, one row per row."""
    spark = docs.sparkSession
    store = ShardStore(spark, target_bytes=target_bytes)
    store.append(docs, rows_per_shard)
    version = store.compact()
    store.vacuum()
    rows = store.read(version)
    if not store.shards():
        return rows.select("doc_id", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(version).alias("version"))
    return rows.select("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(version).alias("version"))
