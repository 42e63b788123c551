"""Queries of placed tags, donors, reference alleles and genetic grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tag_maps, traits
from .genotype_queries import r9
from .registry import query
from .views import WITH, geno, positions


def lineitem(spark, d):
    return spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet")


@query("reference_alleles", WITH + ", s AS (SELECT site_id, chrom, pos, CASE WHEN site_id % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(repeat(translate(md5(CAST(chrom AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 200), pos, 1) AS b FROM positions) SELECT site_id, chrom, pos, strand, CASE WHEN b = '' THEN NULL WHEN strand = '-' THEN translate(b, 'ACGT', 'TGCA') ELSE b END AS ref FROM s")
def reference_alleles(spark, d):
    p = positions(spark, d).select("site_id", "chrom", "pos", F.when(F.col("site_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    bases = F.translate(F.md5(F.col("chrom").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    genome = p.select("chrom").distinct().select("chrom", F.repeat(bases, F.lit(200)).alias("sequence"))
    return tag_maps.reference_alleles(p, genome, 1000)


@query("kept_reads", "SELECT CAST(p_partkey AS VARCHAR) AS read_id, upper(md5(p_type)) AS seq FROM part WHERE substr(upper(md5(p_type)), 3, 2) IN (SELECT substr(upper(md5(p_name)), 1, 2) FROM part WHERE p_partkey % 9 = 0)")
def kept_reads(spark, d):
    p = spark.read.parquet(f"{d.rstrip('/')}/part.parquet")
    tags = p.where("p_partkey % 9 = 0").select(F.upper(F.md5("p_name")).alias("tag"))
    return tag_maps.kept_reads(p.select(F.col("p_partkey").cast("string").alias("read_id"), F.upper(F.md5("p_type")).alias("seq")), tags, 3, 2)


@query("paired_tags", "SELECT least(l_partkey % 40, l_suppkey) AS tag1, greatest(l_partkey % 40, l_suppkey) AS tag2, CAST(sum(l_linenumber) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2")
def paired_tags(spark, d):
    return tag_maps.paired_tags(lineitem(spark, d).select((F.col("l_partkey") % 40).alias("tag1"), F.col("l_suppkey").alias("tag2"), F.col("l_linenumber").alias("count")))


@query("tag_map_summary", "SELECT chrom, count(*) AS tags, count(DISTINCT pos) AS places, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_variants, CAST(sum(v) AS BIGINT) AS variants FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 5 END AS chrom, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS pos, p_partkey % 3 AS v FROM part) GROUP BY 1")
def tag_map_summary(spark, d):
    p = spark.read.parquet(f"{d.rstrip('/')}/part.parquet")
    placed = F.col("p_partkey") % 7 != 0
    v = F.when(F.col("p_partkey") % 3 > 0, F.sequence(F.lit(1), (F.col("p_partkey") % 3).cast("int")))
    return tag_maps.tag_map_summary(p.select(F.col("p_partkey").alias("tag"), F.when(placed, F.col("p_size") % 5).alias("chrom"), F.when(placed, F.col("p_size")).alias("pos"), v.alias("variants")))


@query("hits_outside_blocks", "SELECT l_partkey AS tag, l_linenumber AS chrom, CAST(l_quantity AS INT) AS pos FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p_partkey = l_partkey AND p_partkey % 7 = l_linenumber AND abs(p_size - CAST(l_quantity AS INT)) <= 10)")
def hits_outside_blocks(spark, d):
    own = spark.read.parquet(f"{d.rstrip('/')}/part.parquet").select(F.col("p_partkey").alias("tag"), (F.col("p_partkey") % 7).alias("chrom"), F.col("p_size").alias("pos"))
    return tag_maps.outside_blocks(lineitem(spark, d).select(F.col("l_partkey").alias("tag"), F.col("l_linenumber").alias("chrom"), F.col("l_quantity").cast("int").alias("pos")), own, 10)


@query("top_donors", "WITH g AS (SELECT CAST(l_suppkey AS INT) AS taxon_id, CAST(l_partkey % 25 AS INT) AS donor, CAST(sum(l_linenumber) AS BIGINT) AS errors, CAST(sum(l_linenumber + CAST(l_quantity AS INT)) AS BIGINT) AS compared FROM lineitem GROUP BY 1, 2), o AS (SELECT *, CAST(errors AS DOUBLE) / compared AS s FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY taxon_id ORDER BY s, donor) AS place FROM o) SELECT taxon_id, donor, errors, compared, round(s, 9) AS share, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def top_donors(spark, d):
    e = lineitem(spark, d).select(F.col("l_suppkey").cast("int").alias("taxon_id"), (F.col("l_partkey") % 25).cast("int").alias("donor"), F.col("l_linenumber").alias("errors"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("compared"))
    return tag_maps.top_donors(e).withColumn("share", r9("share"))


@query("grid_markers", WITH + """, c AS (SELECT taxon_id, chrom, pos / CAST(100 AS DOUBLE) AS cm, CASE WHEN NOT (a1 = 15 AND a2 = 15) THEN CAST(2 - CASE WHEN a1 = major THEN 1 ELSE 0 END - CASE WHEN a2 = major THEN 1 ELSE 0 END AS DOUBLE) / 2 END AS v FROM geno g JOIN positions p ON p.site_id = g.site_id JOIN site s ON s.site_id = g.site_id),
  e AS (SELECT chrom, CAST(ceil(min(cm) / 5.0) AS BIGINT) AS lo, CAST(floor(max(cm) / 5.0) AS BIGINT) AS hi FROM c GROUP BY 1), gr AS (SELECT taxon_id, x.chrom, k * CAST(5 AS DOUBLE) AS cm FROM (SELECT DISTINCT taxon_id, chrom FROM c) x JOIN e ON e.chrom = x.chrom JOIN range(0, 100) r(k) ON k BETWEEN lo AND hi),
  kn AS (SELECT taxon_id, chrom, cm, avg(v) AS v FROM c WHERE v IS NOT NULL GROUP BY 1, 2, 3),
  fl AS (SELECT gr.taxon_id, gr.chrom, gr.cm, max(CASE WHEN kn.cm <= gr.cm THEN kn.cm END) AS lx, min(CASE WHEN kn.cm >= gr.cm THEN kn.cm END) AS rx FROM gr LEFT JOIN kn ON kn.taxon_id = gr.taxon_id AND kn.chrom = gr.chrom GROUP BY 1, 2, 3)
  SELECT fl.taxon_id, fl.chrom, fl.cm, round(CASE WHEN rx > lx THEN l.v + (r.v - l.v) * (fl.cm - lx) / (rx - lx) ELSE coalesce(l.v, r.v) END, 9) AS value FROM fl LEFT JOIN kn l ON l.taxon_id = fl.taxon_id AND l.chrom = fl.chrom AND l.cm = lx LEFT JOIN kn r ON r.taxon_id = fl.taxon_id AND r.chrom = fl.chrom AND r.cm = rx""")  # fmt: skip
def grid_markers(spark, d):
    v = traits.collapsed(geno(spark, d)).join(positions(spark, d), "site_id").select("taxon_id", "chrom", (F.col("pos") / F.lit(100.0)).alias("cm"), "value")
    return tag_maps.grid_markers(v, 5.0).withColumn("value", r9("value"))


@query("merged_tag_maps", """WITH m AS (SELECT p_partkey AS tag, CASE WHEN p_size % 4 > 0 THEN p_size % 7 END AS chrom, 1 AS strand, p_size AS pos FROM part UNION ALL SELECT l_partkey, CASE WHEN l_linenumber > 2 THEN l_partkey % 7 END, 1, CAST(l_partkey % 2 * l_linenumber AS INT) FROM lineitem),
  d AS (SELECT DISTINCT tag, chrom, strand, pos FROM m WHERE chrom IS NOT NULL), g AS (SELECT tag, count(*) AS n, min(chrom) AS chrom, min(strand) AS strand, min(pos) AS pos FROM d GROUP BY 1)
  SELECT t.tag, CASE WHEN n = 1 THEN g.chrom END AS chrom, CASE WHEN n = 1 THEN g.strand END AS strand, CASE WHEN n = 1 THEN g.pos END AS pos, CAST(coalesce(n, 0) AS INT) AS places FROM (SELECT DISTINCT tag FROM m) t LEFT JOIN g ON g.tag = t.tag""")  # fmt: skip
def merged_tag_maps(spark, d):
    p = spark.read.parquet(f"{d.rstrip('/')}/part.parquet")
    a = p.select(F.col("p_partkey").alias("tag"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 7).cast("long").alias("chrom"), F.lit(1).alias("strand"), F.col("p_size").cast("int").alias("pos"))
    b = lineitem(spark, d).select(F.col("l_partkey").alias("tag"), F.when(F.col("l_linenumber") > 2, F.col("l_partkey") % 7).cast("long").alias("chrom"), F.lit(1).alias("strand"), (F.col("l_partkey") % 2 * F.col("l_linenumber")).cast("int").alias("pos"))
    return tag_maps.merge_maps(a, b)
