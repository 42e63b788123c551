"""Content-addressed web archive.

Every row becomes one WARC/1.1 record. Payload bytes are stored once, in the response record of their strong digest
(SHA-256); records with an equal payload are revisits that name it. The exact header of every record is also kept apart,
in a table of its own, and original records are rebuilt by joining headers and payloads on the digest. Archives are
written and read by Spark alone, so they may lie in any store that it reaches. Payloads are verified against their
digests when they are read. A WARC file holds file_bytes of payload at most, or a single record that is larger.

Defined results: a null payload is empty; of equal payloads of at least min_bytes the row with the largest id is the
response, and of rows with equal id and payload exactly one is; rows below min_bytes are all responses; a null id is the
smallest; an empty table gives an
empty archive; a null url is empty in the archive, one with line breaks is percent-encoded; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small

CRLF = "\r\n"
HEADERS = "row long, page_id long, url string, record_type string, refers_to long, header string, sha256 string, payload_bytes long"


def base32_of_hex(hex40):
    """Upper-case base32 of a 160-bit digest given in hex, by SQL functions."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hex40, i * 5 + 1, 5), 16, 10).cast("long") for i in range(8)]
    return F.concat(*[F.substring(digits, (F.shiftright(g, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 64 << 20, records_per_file: int = 1000) -> None:
    """Write path/headers (a table), path/warc and path/warc-large (WARC files of at most file_bytes, or of one record)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = materialize(rows.withColumns({"sha256": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}), "payloads")
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups.select("sha256", "first"), "payload-groups")
    told = rows.join(small(groups, 110), "sha256", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    told = told.withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
    told = told.withColumns({"refers_to": F.when(revisit, F.col("first.page_id")), "sha1": F.sha1("payload")})
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    name = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    fields = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"), F.col("row"))),
        F.concat(F.lit("WARC-Target-URI: "), url), F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.col("sha256")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first.page_id"), F.col("first.row")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    told = told.withColumn("header", F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF + CRLF)))
    told.select("row", "page_id", "url", "record_type", "refers_to", "header", "sha256", "payload_bytes").write.parquet(f"{path}/headers")
    block = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise(F.lit(""))
    # Records of up to file_bytes / records_per_file fill files by number; larger ones have files for as many as the largest allows.
    most = file_bytes // records_per_file
    largest = rows.agg(F.max("payload_bytes")).first()[0] or 0
    for folder, some, per_file in (("warc", F.col("payload_bytes") <= most, records_per_file), ("warc-large", F.col("payload_bytes") > most, max(1, file_bytes // max(1, largest)))):
        if folder == "warc" or largest > most:
            record = told.where(some).select(F.concat("header", block).alias("value"))
            record.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(f"{path}/{folder}")


def parse(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, payload) of every record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end].decode("utf-8")
        size = int(header.rsplit("Content-Length: ", 1)[1].split(CRLF, 1)[0])
        yield header, data[end : end + size]
        at = end + size + 4


def field(header: str, name: str) -> str | None:
    for line in header.split(CRLF):
        if line.startswith(name + ": "):
            return line[len(name) + 2 :]
    return None


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the WARC files: row, page_id, url, header, record_type, refers_to, sha256, and its own payload's size and SHA-1 (base32), both checked against the header; with payloads also the payload."""
    names = ["row", "page_id", "url", "header", "record_type", "refers_to", "sha256", "own_bytes", "own_digest", *(["payload"] if payloads else [])]

    def ident(value: str | None) -> list[int | None]:
        return [int(x) if x else None for x in value[len("<urn:page:") : -1].split(":")] if value else [None, None]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in batches:
            for content in b["content"]:
                rows = []
                for header, payload in parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    kind, digest = field(header, "WARC-Type"), field(header, "WARC-Block-Digest").split(":")[1]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {field(header, 'WARC-Record-ID')} differs from its digest")
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    page, row = ident(field(header, "WARC-Record-ID"))
                    told = (row, page, field(header, "WARC-Target-URI"), header, kind, ident(field(header, "WARC-Refers-To"))[0], digest, len(payload), own)
                    rows.append((*told, payload) if payloads else told)
                yield pd.DataFrame(rows, columns=names).astype({"row": "Int64", "page_id": "Int64", "refers_to": "Int64"})

    schema = "row long, page_id long, url string, header string, record_type string, refers_to long, sha256 string, own_bytes long, own_digest string" + ", payload binary" * payloads
    return spark.read.format("binaryFile").load([f"{path}/warc", *([f"{path}/warc-large"] if _exists(spark, f"{path}/warc-large") else [])]).select("content").mapInPandas(records, schema)


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def rebuilt(spark: SparkSession, path: str, contents: DataFrame | None = None) -> DataFrame:
    """row, page_id, url, record_type, refers_to, header and, of contents (by sha256; the archive's payloads unless given), the columns of the content that each header names.

    Contents without copies join by their digest alone; only digests that several records name are looked up by broadcast,
    if they are few, so that a payload that many records share moves once.
    """
    if contents is None:
        contents = read_archive(spark, path, payloads=True).where("record_type = 'response'").select("sha256", "row", "payload")
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers").select("row", "page_id", "url", "record_type", "refers_to", "header", "sha256")
    own = headers.where("record_type = 'response'").join(contents, ["row", "sha256"])
    wanted = materialize(headers.where("record_type = 'revisit'").select("sha256").distinct(), "revisited")
    shared = contents.join(small(wanted, 80), "sha256", "leftsemi").drop("row")
    return own.unionByName(headers.where("record_type = 'revisit'").join(shared, "sha256"))


def archive(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the archive, read it back and rebuild its records: page_id, url, payload_bytes, payload_digest, record_type, refers_to, whole (whether the header in the archive is the stored one)."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_archive(pages, path, min_bytes)
    records = materialize(read_archive(spark, path), "records")
    contents = records.where("record_type = 'response'").select("sha256", "row", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"))
    read = records.select("row", F.xxhash64("header").alias("read"))
    told = rebuilt(spark, path, contents).join(read, "row", "left")
    whole = F.coalesce(F.xxhash64("header") == F.col("read"), F.lit(False))
    return told.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", whole.alias("whole"))
