"""Projection files: each taxon as segments of donor pairs, from calls by site and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def segments(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """taxon_id, chrom, start, end, donor1, donor2: runs of neighbouring sites of a taxon with the same donors. pairs: taxon_id, site_id, donor1, donor2.

    Sites without a row for the taxon don't end a run. A taxon's chromosome is one window.
    """
    w = Window.partitionBy("taxon_id", "chrom").orderBy("pos", "site_id")
    p = pairs.join(positions.select("site_id", "chrom", "pos"), "site_id")
    new = ~(F.lag("donor1").over(w).eqNullSafe(F.col("donor1")) & F.lag("donor2").over(w).eqNullSafe(F.col("donor2"))) | (F.row_number().over(w) == 1)
    p = p.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("taxon_id", "chrom", "run", "donor1", "donor2").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).select("taxon_id", "chrom", "start", "end", "donor1", "donor2")


def write_projection(named: DataFrame, donors: DataFrame, path: str) -> None:
    """named: taxon, chrom, start, end, donor1, donor2 (names of donors, null for no hypothesis). donors: taxon.

    The first line counts donors and taxa; then come the donors with their numbers from 0, by name, and a line a taxon with chrom:start:end:donor:donor.
    """
    from ..functions.tables import row_numbers, small

    d = row_numbers(donors.select("taxon").distinct(), [F.col("taxon")], "i").select(F.col("taxon").alias("donor"), (F.col("i") - 1).alias("i"))
    of = lambda k: small(d.select(F.col("donor").alias(f"donor{k}"), F.col("i").alias(f"i{k}")), 60)
    s = named.join(of(1), "donor1", "left").join(of(2), "donor2", "left")
    text = F.concat_ws(":", F.col("chrom").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("i1", F.lit(-1)).cast("string"), F.coalesce("i2", F.lit(-1)).cast("string"))
    taxa = s.groupBy("taxon").agg(F.array_sort(F.collect_list(F.struct("chrom", "start", text.alias("t")))).alias("x"))
    lines = taxa.select(F.lit(3).alias("k"), F.col("taxon").alias("o"), F.concat_ws("\t", "taxon", F.array_join("x.t", "\t")).alias("value"))
    head = d.agg(F.count(F.lit(1)).alias("n")).join(taxa.agg(F.count(F.lit(1)).alias("m"))).select(F.lit(0).alias("k"), F.lit("").alias("o"), F.concat_ws("\t", F.col("n").cast("string"), F.col("m").cast("string")).alias("value"))  # one row each
    notes = named.sparkSession.createDataFrame([(1, "", "#Donor Haplotypes"), (2, "~", "#Taxa Breakpoints")], "k int, o string, value string")
    own = d.select(F.lit(1).alias("k"), F.lpad(F.col("i").cast("string"), 12, "0").alias("o"), F.concat_ws("\t", F.col("i").cast("string"), "donor").alias("value"))
    head.union(notes).union(own).union(lines).orderBy("k", "o").select("value").write.mode("overwrite").text(path)


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    """taxon, chrom, start, end, donor1, donor2: segments with the names of their donors, null where there is no hypothesis.

    A donor's number that the file doesn't list is refused, and so is a count of donors that isn't that of its lines.
    """
    from ..functions.tables import small

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    head = lines.where(F.col("value").rlike(r"^\d+\t\d+$")).orderBy("file", "block", "id").first()
    if head is None:
        raise ValueError("no line with counts")
    f = F.split("value", "\t")
    donors = lines.where((F.col("id") != head["id"]) & F.col("value").rlike(r"^\d+\t[^\t:]+$")).select(f[0].cast("int").alias("i"), f[1].alias("donor"))
    n = donors.count()
    if n != int(head["value"].split("\t")[0]):
        raise ValueError(f"{n} donors are listed, the first line says {head['value']!r}")
    part = F.split("x", ":")
    s = lines.where(F.col("value").rlike(r"\t[^\t:]+:\d+:\d+:-?\d+:-?\d+")).select(f[0].alias("taxon"), F.explode(F.filter(F.slice(f, 2, 1 << 20), lambda x: x != "")).alias("x"))
    s = s.select("taxon", part[0].alias("chrom"), part[1].cast("int").alias("start"), part[2].cast("int").alias("end"), part[3].cast("int").alias("i1"), part[4].cast("int").alias("i2"))
    of = lambda k: small(donors.select(F.col("i").alias(f"i{k}"), F.col("donor").alias(f"donor{k}")), 60, n)
    s = s.join(of(1), "i1", "left").join(of(2), "i2", "left")
    known = lambda k: F.when((F.col(f"i{k}") >= 0) & F.col(f"donor{k}").isNull(), F.raise_error(F.lit("a donor's number that isn't listed"))).otherwise(F.col(f"donor{k}")).alias(f"donor{k}")
    return s.select("taxon", "chrom", "start", "end", known(1), known(2))
