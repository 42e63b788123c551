"""Queries of site curation, alignment strings, coverage and associations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association, curation, pairs, traits
from .genotype_queries import HOM, r9
from .quality_queries import _BITS, _LD
from .registry import query
from .site_queries import _CALLS
from .views import WITH, geno, positions
from .views import traits as trait_view


def rows(df):
    return df.select("taxon_id", "site_id", "a1", "a2")


_FAR = _LD + """, e AS (SELECT site_i, site_j, r2 FROM ld JOIN positions x ON x.site_id = site_i JOIN positions y ON y.site_id = site_j WHERE r2 IS NOT NULL AND (x.chrom <> y.chrom OR abs(x.pos - y.pos) >= 300)),
  best AS (SELECT site_id, max(r2) AS r2 FROM (SELECT site_i AS site_id, r2 FROM e UNION ALL SELECT site_j, r2 FROM e) GROUP BY 1) """


@query("filter_sites_by_ld", WITH + _FAR + _CALLS + "site_id IN (SELECT site_id FROM best WHERE r2 >= 0.015) OR site_id NOT IN (SELECT site_id FROM best)")
def filter_sites_by_ld(spark, d):
    g = geno(spark, d)
    return rows(curation.sites_by_ld(g, positions(spark, d), pairs.ld(g), 0.015, 300, keep_unproven=True))


_RATE = HOM + ", k AS (SELECT {by}, avg(CASE WHEN p = n AND a1 <> p THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate, count(*) AS m FROM h WHERE p IS NOT NULL AND n IS NOT NULL GROUP BY 1) "


@query("filter_sites_by_double_crossovers", WITH + _RATE.format(by="site_id") + _CALLS + "site_id IN (SELECT site_id FROM k WHERE rate < 0.1 AND m >= 2)")
def filter_sites_by_double_crossovers(spark, d):
    return rows(curation.low_double_crossover(geno(spark, d), "site_id", 0.1, 2))


@query("filter_taxa_by_double_crossovers", WITH + _RATE.format(by="taxon_id") + _CALLS + "taxon_id IN (SELECT taxon_id FROM k WHERE rate <= 0.16 AND m >= 2)")
def filter_taxa_by_double_crossovers(spark, d):
    return rows(curation.low_double_crossover(geno(spark, d), "taxon_id", 0.16, 2))


@query("called_snp_filters", WITH + """, kt AS (SELECT taxon_id FROM geno GROUP BY 1 HAVING avg(CASE WHEN a1 = 15 AND a2 = 15 THEN CAST(0 AS DOUBLE) ELSE 1 END) >= 0.88),
  kg AS (SELECT g.* FROM geno g JOIN kt ON kt.taxon_id = g.taxon_id), ka AS (SELECT site_id, allele, count(*) AS n FROM (SELECT site_id, a1 AS allele FROM kg WHERE a1 < 14 UNION ALL SELECT site_id, a2 FROM kg WHERE a2 < 14) GROUP BY 1, 2),
  kr AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, allele) AS rk FROM ka),
  ks AS (SELECT k.site_id, sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) AS called, sum(CASE WHEN a1 <> a2 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS hets, sum(CASE WHEN a1 = a2 AND a1 = allele THEN CAST(1 AS DOUBLE) ELSE 0 END) AS hm FROM kg k LEFT JOIN kr ON kr.site_id = k.site_id AND rk = 2 GROUP BY 1),
  km AS (SELECT *, CASE WHEN called > 0 THEN (hm + hets / 2) / called END AS maf FROM ks)
  SELECT taxon_id, site_id, a1, a2 FROM kg WHERE site_id IN (SELECT site_id FROM km WHERE called >= 2 AND maf BETWEEN 0.1 AND 0.5 AND CASE WHEN 2 * maf * (1 - maf) > 0 THEN 1 - hets / called / (2 * maf * (1 - maf)) ELSE 1 END > 0.2)""")  # fmt: skip
def called_snp_filters(spark, d):
    return rows(curation.called_snp_filters(geno(spark, d), 0.88, 2, 0.2, 0.1, 0.5))


def near_positions(spark, d):
    """Positions a tenth as far apart, several sites to a tag."""
    return positions(spark, d).withColumn("pos", F.floor(F.col("pos") / 10).cast("int"))


@query("same_tag_sites")
def same_tag_sites(spark, d):
    return curation.same_tag_sites(near_positions(spark, d), pairs.ld(geno(spark, d), min_taxa=2), 0.004)


@query("merge_duplicate_sites")
def merge_duplicate_sites(spark, d):
    p = positions(spark, d).withColumn("pos", F.floor(F.col("pos") / 400).cast("int"))
    return rows(curation.merge_duplicate_sites(geno(spark, d), p, 0.5))


@query("depth_codes", """SELECT l_orderkey, l_linenumber, d, CAST(c AS INT) AS code, CAST(CASE WHEN c >= 0 THEN c WHEN c >= -55 THEN 127 - c ELSE 126 + floor(pow(1.0746, 0.5 - c)) END AS INT) AS depth FROM (SELECT *, CASE WHEN d <= 127 THEN d WHEN d <= 182 THEN 127 - d ELSE greatest(-128, -floor(ln(d - 126) / ln(1.0746))) END AS c FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS INT) % (l_linenumber * 150) AS d FROM lineitem))""")
def depth_codes(spark, d):
    t = spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice") % (F.col("l_linenumber") * 150)).cast("int").alias("d"))
    return t.withColumn("code", curation.encoded_depth("d")).withColumn("depth", curation.decoded_depth("code"))


@query("aligned_ends", "SELECT p_partkey, cigar, CAST(1000 - CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS INT) AS start_pos, CAST(1000 + 20 + p_size % 7 + CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 0 END - 1 AS INT) AS end_pos FROM (SELECT *, concat(CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(p_size AS VARCHAR), 'S') ELSE '' END, '20M', CAST(p_partkey % 9 + 1 AS VARCHAR), 'I', CAST(p_size % 7 AS VARCHAR), 'D', CASE WHEN p_partkey % 5 = 0 THEN '4S' ELSE '' END) AS cigar FROM part)")
def aligned_ends(spark, d):
    k = lambda c, s: F.when(c, s).otherwise(F.lit(""))
    cigar = F.concat(k(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit("S"))), F.lit("20M"), F.col("p_partkey") % 9 + 1, F.lit("I"), F.col("p_size") % 7, F.lit("D"), k(F.col("p_partkey") % 5 == 0, F.lit("4S")))
    p = spark.read.parquet(f"{d.rstrip('/')}/part.parquet").select("p_partkey", cigar.alias("cigar"), F.lit(1000).alias("pos"))
    start, end = curation.aligned_ends()
    return p.select("p_partkey", "cigar", start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos"))


@query("reads_per_sample", "SELECT CAST(l_suppkey AS VARCHAR) AS taxon, count(*) AS reads, count(DISTINCT l_partkey % 31) AS sequences FROM lineitem GROUP BY 1")
def reads_per_sample(spark, d):
    t = spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet")
    return curation.reads_per_sample(t.select(F.col("l_suppkey").cast("string").alias("taxon"), (F.col("l_partkey") % 31).cast("string").alias("seq")))


@query("locus_cover", "SELECT l_partkey % 50 AS locus, count(DISTINCT l_suppkey) AS taxa, CAST(sum(l_linenumber - 1) AS BIGINT) AS reads, count(DISTINCT l_partkey) AS tags FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def locus_cover(spark, d):
    t = spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet")
    return curation.locus_cover(t.select((F.col("l_partkey") % 50).alias("locus"), F.col("l_partkey").alias("tag"), F.col("l_suppkey").alias("taxon"), (F.col("l_linenumber") - 1).alias("count")))


@query("marker_consistency", r"SELECT min(CASE WHEN regexp_full_match(label, '[-+]?\d+(\.\d+)?') THEN 1 ELSE 0 END) = max(CASE WHEN regexp_full_match(label, '[-+]?\d+(\.\d+)?') THEN 1 ELSE 0 END) AS same_kind, min(len(string_split(label, ':'))) = max(len(string_split(label, ':'))) AS same_ploidy FROM (SELECT replace(p_type, ' ', ':') AS label FROM part)")
def marker_consistency(spark, d):
    p = spark.read.parquet(f"{d.rstrip('/')}/part.parquet")
    return curation.marker_consistency(p.select(F.col("p_partkey").alias("name"), F.replace("p_type", F.lit(" "), F.lit(":")).alias("label")))


@query("missing_counts", WITH + "SELECT 't1' AS name, count(*) - count(t1) AS missing, count(t1) AS present FROM traits UNION ALL SELECT 'f1', count(*) - count(f1), count(f1) FROM traits UNION ALL SELECT NULL, CAST(sum(CASE WHEN t1 IS NULL OR f1 IS NULL THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN t1 IS NULL OR f1 IS NULL THEN 0 ELSE 1 END) AS BIGINT) FROM traits")
def missing_counts(spark, d):
    return curation.missing_counts(trait_view(spark, d), ["t1", "f1"])


@query("numeric_relationship", WITH + """, x AS (SELECT taxon_id, g.site_id, CAST(2 - CASE WHEN a1 = major THEN 1 ELSE 0 END - CASE WHEN a2 = major THEN 1 ELSE 0 END AS DOUBLE) AS v FROM geno g JOIN site s ON s.site_id = g.site_id WHERE NOT (a1 = 15 AND a2 = 15)),
  m AS (SELECT site_id, avg(v) / 2 AS p FROM x GROUP BY 1), c AS (SELECT taxon_id, x.site_id, v - 2 * p AS w FROM x JOIN m ON m.site_id = x.site_id)
  SELECT a.taxon_id AS taxon_i, b.taxon_id AS taxon_j, round(sum(a.w * b.w) / (SELECT 2 * sum(p * (1 - p)) FROM m), 6) AS k FROM c a JOIN c b ON b.site_id = a.site_id AND a.taxon_id <= b.taxon_id GROUP BY 1, 2""")  # fmt: skip
def numeric_relationship(spark, d):
    v = traits.collapsed(geno(spark, d)).select("taxon_id", F.col("site_id").alias("marker"), (F.col("value") * 2).alias("value"))
    return association.relationship(v).withColumn("k", F.round("k", 6))


@query("tag_association", WITH + _BITS + """, tg AS (SELECT DISTINCT concat('t', CAST(l_partkey % 7 AS VARCHAR)) AS tag, CAST(l_suppkey AS INT) AS taxon_id FROM lineitem WHERE l_quantity > 30),
  al AS (SELECT site_id, CAST(sum(CASE WHEN mn THEN 1 ELSE 0 END) AS BIGINT) AS mna, CAST(sum(CASE WHEN mj THEN 1 ELSE 0 END) AS BIGINT) AS mja FROM mm GROUP BY 1),
  c AS (SELECT tag, site_id, CAST(sum(CASE WHEN mn THEN 1 ELSE 0 END) AS BIGINT) AS minor, CAST(sum(CASE WHEN mj THEN 1 ELSE 0 END) AS BIGINT) AS major FROM tg, (SELECT DISTINCT site_id, floor(taxon_id / 64) AS b FROM mm) x LEFT JOIN mm USING (site_id) WHERE mm.taxon_id = tg.taxon_id AND floor(mm.taxon_id / 64) = x.b GROUP BY 1, 2),
  q AS (SELECT c.*, minor + major AS n, least(minor, major) AS k, CASE WHEN minor < major THEN mna ELSE mja END / CAST(mna + mja AS DOUBLE) AS s FROM c JOIN al ON al.site_id = c.site_id)
  SELECT tag, site_id, minor, major, round(CASE WHEN n < 4 OR s >= 1 OR s <= 0 OR s IS NULL THEN 1.0 ELSE least(1.0, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(s) + (n - i) * ln(1 - s)) for i in range(0, k + 1)])) END, 6) AS p FROM q WHERE minor + major > 0""")  # fmt: skip
def tag_association(spark, d):
    t = spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet").where("l_quantity > 30")
    t = t.select(F.concat(F.lit("t"), F.col("l_partkey") % 7).alias("tag"), F.col("l_suppkey").cast("int").alias("taxon_id"))
    return association.tag_association(t, geno(spark, d)).where("minor + major > 0").withColumn("p", F.round("p", 6))


_ORDERS = "orders.parquet"


def orders(spark, d):
    o = spark.read.parquet(f"{d.rstrip('/')}/{_ORDERS}")
    return o.select((F.col("o_custkey") % 20).cast("int").alias("taxon_id"), F.col("o_orderpriority").alias("trait"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("env"))


@query("estimates_by_taxon", "SELECT o_orderpriority AS trait, CAST(o_custkey % 20 AS INT) AS taxon_id, count(*) AS n, round(avg(o_totalprice), 4) AS blue FROM orders GROUP BY 1, 2")
def estimates_by_taxon(spark, d):
    return association.estimates_by_taxon(orders(spark, d)).withColumn("blue", F.round("blue", 4))


@query("estimates_with_factor")
def estimates_with_factor(spark, d):
    return association.estimates_by_taxon(orders(spark, d), ["env"])


@query("mixed_association")
def mixed_association(spark, d):
    return association.mixed_association_of_calls(geno(spark, d), trait_view(spark, d).select("taxon_id", F.col("t1").alias("value")))
