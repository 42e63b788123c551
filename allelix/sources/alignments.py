"""Alignments of tags in SAM text: places, and variants against the reference from the CIGAR and MD fields, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEGMENTS = "struct<q:int,r:int,segs:array<struct<op:string,n:int,q:int,r:int>>>"
_MARKS = "struct<r:int,marks:array<struct<r:int,ref:string,deleted:boolean>>>"


def cigar_segments(cigar: Column) -> Column:
    """array of (op, n, q, r): each operation with its length and where it begins in the read and on the reference, from 0."""
    parts = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])")), lambda x: F.struct(F.substring(x, F.length(x), F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n")))
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<op:string,n:int,q:int,r:int>>").alias("segs")).cast(_SEGMENTS)

    def step(acc, x):
        seg = F.struct(x["op"].alias("op"), x["n"].alias("n"), acc["q"].alias("q"), acc["r"].alias("r"))
        q = acc["q"] + F.when(x["op"].isin("M", "I", "S", "=", "X"), x["n"]).otherwise(0)
        r = acc["r"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0)
        return F.struct(q.alias("q"), r.alias("r"), F.concat(acc["segs"], F.array(seg)).alias("segs")).cast(_SEGMENTS)

    whole = F.array(F.struct(F.lit("M").alias("op"), F.regexp_substr(cigar, F.lit(r"^\d+")).cast("int").alias("n"), F.lit(0).alias("q"), F.lit(0).alias("r")))
    return F.when(cigar.rlike(r"^\d+M$"), whole).otherwise(F.aggregate(parts, start, step)["segs"])  # one operation is most lines


def md_marks(md: Column) -> Column:
    """array of (r, ref, deleted): mismatched and deleted reference bases with their place on the reference, from 0, skipped parts not counted."""
    parts = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"))
    start = F.struct(F.lit(0).alias("r"), F.array().cast("array<struct<r:int,ref:string,deleted:boolean>>").alias("marks")).cast(_MARKS)

    def step(acc, x):
        number, deleted = x.rlike(r"^\d"), x.startswith("^")
        bases = F.upper(F.regexp_replace(x, r"[\^0-9]", ""))
        mark = F.struct(acc["r"].alias("r"), bases.alias("ref"), deleted.alias("deleted"))
        r = acc["r"] + F.when(number, F.expr("0")).otherwise(F.length(bases)) + F.when(number, x.try_cast("int")).otherwise(0)
        return F.struct(r.alias("r"), F.when(number, acc["marks"]).otherwise(F.concat(acc["marks"], F.array(mark))).alias("marks")).cast(_MARKS)

    none = F.array().cast("array<struct<r:int,ref:string,deleted:boolean>>")
    return F.when(md.rlike(r"^\d*$"), none).otherwise(F.aggregate(parts, start, step)["marks"])


def variants(pos: Column, segs: Column, marks: Column, seq: Column) -> Column:
    """From cigar_segments and md_marks, as columns so that they are made once: array of (pos, ref, alt) by place on the reference: mismatches one base each, deletions with alt '-', insertions with ref '-' at the base before them."""
    kind = "array<struct<pos:int,ref:string,alt:string>>"

    def base(m):
        inside = F.filter(segs, lambda s: s["op"].isin("M", "=", "X") & (s["r"] <= m["r"]) & (m["r"] < s["r"] + s["n"]))
        s = F.get(inside, F.lit(0))
        return F.upper(F.substring(seq, s["q"] + m["r"] - s["r"] + 1, F.lit(1)))

    of = lambda p, ref, alt: F.struct(p.cast("int").alias("pos"), ref.alias("ref"), alt.alias("alt"))
    marked = F.transform(marks, lambda m: of(pos + m["r"], m["ref"], F.when(m["deleted"], F.lit("-")).otherwise(base(m))))
    inserted = F.transform(F.filter(segs, lambda s: s["op"] == "I"), lambda s: of(pos + s["r"] - 1, F.lit("-"), F.upper(F.substring(seq, s["q"] + 1, s["n"]))))
    none = (F.size(marks) == 0) & ~F.exists(segs, lambda s: s["op"] == "I")
    return F.when(none, F.array().cast(kind)).otherwise(F.array_sort(F.concat(marked.cast(kind), inserted.cast(kind))))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """name, tag, len, chrom, strand, pos, end, hits, divergence, cigar, md, variants; a row an alignment, one that isn't aligned has no place.

    pos is the first aligned base on the reference and end the last. On the minus strand the tag is the read as it was sequenced. hits is the aligner's X0 or NH
    count, divergence its NM. Lines that begin with @ are headers; lines of fewer than eleven fields are refused.
    """
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    of = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:[AifZHB]:([^\t]*)", 1), F.lit(""))
    checked = F.when(F.size(f) >= 11, f).otherwise(F.raise_error(F.concat(F.lit("not an alignment: "), F.substring("value", 1, 80))).cast("array<string>"))
    r = lines.select(checked.alias("f"), of("MD").alias("md"), F.coalesce(of("X0"), of("NH")).cast("int").alias("hits"), of("NM").cast("int").alias("divergence"))
    flag, cigar = F.col("f")[1].cast("int"), F.col("f")[5]
    placed = (flag.bitwiseAND(4) == 0) & (F.col("f")[2] != "*") & (cigar != "*")
    minus = flag.bitwiseAND(16) != 0
    r = r.select(F.col("f")[0].alias("name"), F.upper(F.col("f")[9]).alias("seq"), placed.alias("placed"), minus.alias("minus"), F.col("f")[2].alias("chrom"), F.col("f")[3].cast("int").alias("pos"), cigar.alias("cigar"), "md", "hits", "divergence")
    r = r.withColumns({"segs": cigar_segments(F.col("cigar")), "marks": md_marks(F.coalesce("md", F.lit("")))})
    span = F.aggregate(F.transform(F.filter(F.col("segs"), lambda s: s["op"].isin("M", "D", "N", "=", "X")), lambda s: s["n"]), F.lit(0), lambda a, n: a + n)
    when = lambda x: F.when(F.col("placed"), x)
    turned = F.reverse(F.translate(F.col("seq"), "ACGT", "TGCA"))
    return r.select(
        "name", F.when(F.col("minus"), turned).otherwise(F.col("seq")).alias("tag"), F.length("seq").alias("len"), when(F.col("chrom")).alias("chrom"), when(F.when(F.col("minus"), -1).otherwise(1)).alias("strand"), when(F.col("pos")).alias("pos"),
        when(F.col("pos") + span - 1).alias("end"), "hits", "divergence", when(F.col("cigar")).alias("cigar"), "md", when(variants(F.col("pos"), F.col("segs"), F.col("marks"), F.col("seq"))).alias("variants"),
    )
