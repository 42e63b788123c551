"""Placed tags, reads by their start, donors by error, reference alleles and markers on a fixed genetic grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reference_alleles(positions: DataFrame, genome: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """positions (site_id, chrom, pos, strand) with ref, the base of the genome at pos (from 1), complemented on the minus strand; null beyond the sequence.

    genome: chrom, sequence. Sequences are cut into chunks, so that positions meet them by equality of chromosome and chunk.
    """
    n = F.ceil(F.length("sequence") / chunk).cast("int")
    parts = genome.where(F.length("sequence") > 0).select("chrom", "sequence", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    parts = parts.select("chrom", "part", F.substring("sequence", F.col("part") * chunk + 1, F.lit(chunk)).alias("s"))
    p = positions.withColumn("part", F.floor((F.col("pos") - 1) / chunk).cast("int")).join(parts, ["chrom", "part"], "left")
    base = F.upper(F.substring("s", F.col("pos") - F.col("part") * chunk, F.lit(1)))
    ref = F.when(F.col("strand") == "-", F.translate(base, "ACGT", "TGCA")).otherwise(base)
    return p.select(*positions.columns, F.when(ref != "", ref).alias("ref"))


def kept_reads(reads: DataFrame, tags: DataFrame, start: int, length: int) -> DataFrame:
    """Reads whose bases from start (from 1) are a listed tag's first length bases."""
    heads = tags.select(F.substring("tag", 1, length).alias("__head")).distinct()
    return reads.withColumn("__head", F.substring("seq", start, length)).join(heads, "__head", "leftsemi").drop("__head")


def paired_tags(counts: DataFrame) -> DataFrame:
    """tag1, tag2, count of several tables of read pairs, the smaller tag first; equal pairs add up."""
    return counts.groupBy(F.least("tag1", "tag2").alias("tag1"), F.greatest("tag1", "tag2").alias("tag2")).agg(F.sum("count").alias("count"))


def tag_map_summary(tag_map: DataFrame) -> DataFrame:
    """tag_map: tag, chrom, pos, variants (array). Per chromosome (null for unplaced tags): tags, places, tags with variants, variants."""
    n = F.greatest(F.size(F.coalesce("variants", F.array().cast("array<int>"))), F.lit(0))
    place = tag_map.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("tags"), F.count_if(n > 0).alias("with_variants"), F.sum(n).alias("variants"))
    return place.groupBy("chrom").agg(F.sum("tags").alias("tags"), F.count("pos").alias("places"), F.sum("with_variants").alias("with_variants"), F.sum("variants").alias("variants"))


def outside_blocks(hits: DataFrame, own: DataFrame, span: int) -> DataFrame:
    """hits (tag, chrom, pos) but those within span of a place of the tag itself (own: tag, chrom, pos)."""
    o = own.select("tag", "chrom", F.col("pos").alias("own_pos"))
    near = hits.join(o, ["tag", "chrom"]).where(F.abs(F.col("pos") - F.col("own_pos")) <= span).select("tag", "chrom", "pos").distinct()
    return hits.join(near, ["tag", "chrom", "pos"], "leftanti")


def top_donors(errors: DataFrame, k: int = 10) -> DataFrame:
    """errors: taxon_id, donor, errors, compared (any number of rows a donor). The k donors of each taxon with the least error share over all rows; ties go to the smaller donor."""
    g = errors.groupBy("taxon_id", "donor").agg(F.sum("errors").alias("errors"), F.sum("compared").alias("compared")).where("compared > 0")
    g = g.withColumn("share", F.col("errors") / F.col("compared"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("taxon_id").orderBy("share", "donor"))).where(F.col("place") <= k)


def grid_markers(calls: DataFrame, interval: float) -> DataFrame:
    """calls: taxon_id, chrom, cm, value. Values of each taxon at the multiples of interval between its chromosome's first and last marker, linear between the flanking calls, or the only one's; null without any."""
    ends = calls.groupBy("chrom").agg(F.ceil(F.min("cm") / interval).cast("long").alias("lo"), F.floor(F.max("cm") / interval).cast("long").alias("hi")).where("lo <= hi")
    taxa = calls.select("taxon_id", "chrom").distinct()
    grid = taxa.join(ends, "chrom").select("taxon_id", "chrom", F.explode(F.sequence("lo", "hi")).alias("step"))
    grid = grid.select("taxon_id", "chrom", "step", (F.col("step") * interval).alias("cm"), F.lit(None).cast("double").alias("value"))
    seen = calls.where("value is not null").groupBy("taxon_id", "chrom", "cm").agg(F.avg("value").alias("value"))
    both = grid.unionByName(seen.withColumn("step", F.lit(None).cast("long")))
    known = F.when(F.col("value").isNotNull(), F.struct("cm", "value"))
    w = Window.partitionBy("taxon_id", "chrom").orderBy("cm")
    both = both.withColumns({"l": F.last(known, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "r": F.first(known, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))})
    lv, rv, lx, rx = F.col("l.value"), F.col("r.value"), F.col("l.cm"), F.col("r.cm")
    at = F.when(rx > lx, lv + (rv - lv) * (F.col("cm") - lx) / (rx - lx)).otherwise(F.coalesce(lv, rv))
    return both.where("step is not null").select("taxon_id", "chrom", "cm", at.alias("value"))


def merge_maps(*maps: DataFrame) -> DataFrame:
    """tag, chrom, strand, pos, places: all tags of the maps (tag, chrom, strand, pos). A tag that all maps which place it put at one place keeps it; one with several places has none, and places counts them."""
    every = reduce(lambda a, b: a.unionByName(b), [m.select("tag", "chrom", "strand", "pos") for m in maps])
    place = F.when(F.col("chrom").isNotNull() & F.col("pos").isNotNull(), F.struct("chrom", "strand", "pos"))
    g = every.groupBy("tag").agg(F.min(place).alias("lo"), F.size(F.collect_set(place)).alias("places"))
    one = F.when(F.col("places") == 1, F.col("lo"))
    return g.select("tag", one["chrom"].alias("chrom"), one["strand"].alias("strand"), one["pos"].alias("pos"), "places")
