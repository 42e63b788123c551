"""Queries of error rates, pair reports, correlations and divisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs, quality, summary, traits
from .genotype_queries import r9
from .registry import query
from .views import WITH, geno, positions
from .views import traits as trait_view

_BITS = """, mm AS (SELECT g.taxon_id, g.site_id, a1, a2, coalesce(a1 = major OR a2 = major, false) AS mj, coalesce(a1 = minor OR a2 = minor, false) AS mn FROM geno g JOIN site s ON s.site_id = g.site_id)"""
_IBS = _BITS + """, ib AS (SELECT x.taxon_id AS taxon_i, y.taxon_id AS taxon_j,
  CAST(sum(CASE WHEN (x.mj AND y.mj) OR (x.mn AND y.mn) THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN (x.mj AND y.mn) OR (x.mn AND y.mj) THEN 1 ELSE 0 END) AS BIGINT) AS diff,
  CAST(sum(CASE WHEN ((x.mj AND y.mj) OR (x.mn AND y.mn)) AND ((x.mj AND y.mn) OR (x.mn AND y.mj)) THEN 1 ELSE 0 END) AS BIGINT) AS het
  FROM mm x JOIN mm y ON x.site_id = y.site_id AND x.taxon_id < y.taxon_id GROUP BY 1, 2),
  dist AS (SELECT taxon_i, taxon_j, same + diff - het AS sites, CASE WHEN same + diff - het > 0 THEN 1 - (same - het / CAST(2 AS DOUBLE)) / (same + diff - het) END AS dist FROM ib)"""
_HOM = _BITS + """, cr AS (SELECT x.site_id AS site_i, y.site_id AS site_j, CAST(sum(CASE WHEN x.mj AND y.mj THEN 1 ELSE 0 END) AS BIGINT) AS xy, CAST(sum(CASE WHEN x.mj THEN 1 ELSE 0 END) AS BIGINT) AS sx,
  CAST(sum(CASE WHEN y.mj THEN 1 ELSE 0 END) AS BIGINT) AS sy, count(*) AS n FROM mm x JOIN mm y ON x.taxon_id = y.taxon_id AND x.site_id < y.site_id AND y.site_id - x.site_id <= 50
  WHERE x.a1 = x.a2 AND y.a1 = y.a2 AND (x.mj OR x.mn) AND (y.mj OR y.mn) GROUP BY 1, 2),
  corr AS (SELECT site_i, site_j, n, CASE WHEN n > 1 AND sx * (n - sx) > 0 AND sy * (n - sy) > 0 THEN (n * xy - sx * sy) / sqrt(CAST(sx * (n - sx) AS DOUBLE) * (sy * (n - sy))) END AS r FROM cr)"""
_LD = _BITS + """, q AS (SELECT x.site_id AS site_i, y.site_id AS site_j, CAST(sum(CASE WHEN x.mn AND y.mn THEN 1 ELSE 0 END) AS DOUBLE) AS ab, CAST(sum(CASE WHEN x.mn AND y.mj THEN 1 ELSE 0 END) AS DOUBLE) AS ab2,
  CAST(sum(CASE WHEN x.mj AND y.mn THEN 1 ELSE 0 END) AS DOUBLE) AS a2b, CAST(sum(CASE WHEN x.mj AND y.mj THEN 1 ELSE 0 END) AS DOUBLE) AS a2b2 FROM mm x JOIN mm y ON x.taxon_id = y.taxon_id AND x.site_id < y.site_id AND y.site_id - x.site_id <= 50 GROUP BY 1, 2),
  f AS (SELECT *, ab + ab2 + a2b + a2b2 AS n FROM q), h AS (SELECT *, (a2b + a2b2) / nullif(n, 0) AS pa, (ab2 + a2b2) / nullif(n, 0) AS pb FROM f),
  ld AS (SELECT site_i, site_j, CASE WHEN n >= 20 AND ab + ab2 >= 2 AND ab + a2b >= 2 AND pa > 0 AND pa < 1 AND pb > 0 AND pb < 1 THEN (a2b2 / n - pa * pb) * (a2b2 / n - pa * pb) / (pa * (1 - pa) * pb * (1 - pb)) END AS r2 FROM h WHERE n > 0)"""
_MASKED = """, mask AS (SELECT taxon_id, site_id, CASE WHEN (taxon_id * 7 + site_id) % 10 = 0 THEN 15 ELSE a1 END AS a1, CASE WHEN (taxon_id * 7 + site_id) % 10 = 0 THEN 15 ELSE a2 END AS a2 FROM geno),
  mg AS (SELECT site_id, a1 AS allele FROM mask WHERE a1 < 14 UNION ALL SELECT site_id, a2 FROM mask WHERE a2 < 14), mc AS (SELECT site_id, allele, count(*) AS n FROM mg GROUP BY 1, 2),
  mr AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, allele) AS rk FROM mc),
  imp AS (SELECT m.taxon_id, m.site_id, CASE WHEN a1 = 15 AND a2 = 15 AND allele IS NOT NULL THEN allele ELSE a1 END AS a1, CASE WHEN a1 = 15 AND a2 = 15 AND allele IS NOT NULL THEN allele ELSE a2 END AS a2 FROM mask m LEFT JOIN mr ON mr.site_id = m.site_id AND rk = 1)"""


def masked(spark, d):
    at = F.pmod(F.col("taxon_id") * 7 + F.col("site_id"), F.lit(10)) == 0
    return geno(spark, d).select("taxon_id", "site_id", *[F.when(at, F.lit(15)).otherwise(F.col(a)).alias(a) for a in ("a1", "a2")])


@query("ld_bins", WITH + _LD + ", b AS (SELECT CAST(least(99, floor(round(r2, 9) * 100)) AS INT) AS bin, count(*) AS n FROM ld WHERE r2 IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM ld WHERE r2 IS NULL HAVING count(*) > 0) SELECT bin, n, CASE WHEN bin IS NOT NULL THEN round(CAST(sum(CASE WHEN bin IS NOT NULL THEN n END) OVER (ORDER BY bin NULLS FIRST) AS DOUBLE) / sum(CASE WHEN bin IS NOT NULL THEN n END) OVER (), 9) END AS share FROM b")
def ld_bins(spark, d):
    return quality.ld_bins(pairs.ld(geno(spark, d)).where("n > 0")).withColumn("share", r9("share"))


@query("ld_mean_by_site", WITH + _LD + ", e AS (SELECT site_i AS site_id, r2 FROM ld WHERE r2 IS NOT NULL UNION ALL SELECT site_j, r2 FROM ld WHERE r2 IS NOT NULL) SELECT site_id, count(*) AS pairs, round(avg(r2), 9) AS mean_r2 FROM e GROUP BY 1")
def ld_mean_by_site(spark, d):
    return quality.mean_r2(pairs.ld(geno(spark, d))).withColumn("mean_r2", r9("mean_r2"))


@query("non_consensus_share", WITH + "SELECT taxon_id, count(*) AS called, round(avg(CASE WHEN a1 <> major OR a2 <> major THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS share FROM geno g JOIN site s ON s.site_id = g.site_id WHERE NOT (a1 = 15 AND a2 = 15) GROUP BY 1")
def non_consensus_share(spark, d):
    return quality.non_consensus(geno(spark, d)).withColumn("share", r9("share"))


@query("duplicate_error_rate", WITH + """, nm AS (SELECT DISTINCT taxon_id, concat('L', CAST(taxon_id % 4 AS STRING), ':', CAST(taxon_id AS STRING)) AS name, taxon_id % 4 AS line FROM geno),
  pr AS (SELECT taxon_id AS taxon_i, lead(taxon_id) OVER (PARTITION BY line ORDER BY name, taxon_id) AS taxon_j FROM nm)
  SELECT taxon_i, taxon_j, count(*) AS compared, CAST(sum(CASE WHEN x.a1 <> y.a1 THEN 1 ELSE 0 END) AS BIGINT) AS differing, round(avg(CASE WHEN x.a1 <> y.a1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS rate
  FROM pr JOIN geno x ON x.taxon_id = taxon_i JOIN geno y ON y.taxon_id = taxon_j AND y.site_id = x.site_id WHERE x.a1 = x.a2 AND y.a1 = y.a2 AND x.a1 < 15 AND y.a1 < 15 GROUP BY 1, 2""")  # fmt: skip
def duplicate_error_rate(spark, d):
    names = geno(spark, d).select("taxon_id").distinct().withColumn("name", F.concat(F.lit("L"), F.pmod("taxon_id", F.lit(4)).cast("string"), F.lit(":"), F.col("taxon_id").cast("string")))
    return quality.duplicate_error(geno(spark, d), names).withColumn("rate", r9("rate"))


@query("impute_major", WITH + _MASKED + " SELECT taxon_id, site_id, a1, a2 FROM imp")
def impute_major(spark, d):
    return quality.impute_major(masked(spark, d))


@query("imputation_accuracy", WITH + _MASKED + """ SELECT CASE WHEN i.a1 = 15 THEN 'unimputed' WHEN least(g.a1, g.a2) = least(i.a1, i.a2) AND greatest(g.a1, g.a2) = greatest(i.a1, i.a2) THEN 'correct' WHEN g.a1 <> g.a2 OR i.a1 <> i.a2 THEN 'het' ELSE 'error' END AS outcome, count(*) AS n
  FROM geno g JOIN imp i ON i.taxon_id = g.taxon_id AND i.site_id = g.site_id WHERE (g.taxon_id * 7 + g.site_id) % 10 = 0 AND NOT (g.a1 = 15 AND g.a2 = 15) GROUP BY 1""")  # fmt: skip
def imputation_accuracy(spark, d):
    at = geno(spark, d).where("(taxon_id * 7 + site_id) % 10 = 0")
    return quality.imputation_accuracy(geno(spark, d), quality.impute_major(masked(spark, d)), at)


@query("segregating_count", WITH + "SELECT count(*) AS sites, CAST(sum(CASE WHEN minor_n > 0 AND CAST(minor_n AS DOUBLE) / gametes >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS segregating FROM site")
def segregating_count(spark, d):
    return quality.segregating_count(geno(spark, d), 0.1)


_HIST = ", hb AS (SELECT site_id, CAST(greatest(0, least(19, floor((CAST(minor_n AS DOUBLE) / gametes - 0.0) / (CAST(0.5 AS DOUBLE) / 20)))) AS INT) AS bin FROM site WHERE gametes > 0)"


@query("histogram_share_below", WITH + _HIST + " SELECT round(avg(CASE WHEN bin < 10 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS share FROM hb")
def histogram_share_below(spark, d):
    return quality.share_below(summary.histogram(summary.site_stats(geno(spark, d)), "maf", 0.0, 0.5, 20), 10).select(r9("share").alias("share"))


@query("histogram_ks", WITH + _HIST + """, hc AS (SELECT bin, sum(CASE WHEN site_id < 100 THEN 1 ELSE 0 END) AS x, sum(CASE WHEN site_id < 100 THEN 0 ELSE 1 END) AS y FROM hb GROUP BY 1),
  hd AS (SELECT abs(CAST(sum(x) OVER (ORDER BY bin) AS DOUBLE) / sum(x) OVER () - CAST(sum(y) OVER (ORDER BY bin) AS DOUBLE) / sum(y) OVER ()) AS d FROM hc) SELECT round(max(d), 9) AS d FROM hd""")  # fmt: skip
def histogram_ks(spark, d):
    s = summary.site_stats(geno(spark, d))
    a, b = (summary.histogram(s.where(c), "maf", 0.0, 0.5, 20) for c in ("site_id < 100", "site_id >= 100"))
    return quality.kolmogorov_smirnov(a, b).select(r9("d").alias("d"))


@query("majority_allele", WITH + "SELECT site_id, CASE WHEN CAST((major_n - minor_n) * (major_n - minor_n) AS DOUBLE) / (major_n + minor_n) > 3.841458820694124 THEN major END AS allele FROM site")
def majority_allele(spark, d):
    return quality.majority(geno(spark, d))


@query("chromosome_blocks", WITH + ", o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, site_id) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM positions) SELECT chrom, pos, site_id, CAST(floor(CAST(i * greatest(1, floor(n / 16)) AS DOUBLE) / n) AS INT) AS block FROM o")
def chromosome_blocks(spark, d):
    return quality.blocks(positions(spark, d), 16).select("chrom", "pos", "site_id", "block")


@query("distance_to_taxon", WITH + _BITS + """, o AS (SELECT y.taxon_id, chrom, CAST(floor(pos / 2000) AS INT) AS range, (x.mj AND y.mj) OR (x.mn AND y.mn) AS s, (x.mj AND y.mn) OR (x.mn AND y.mj) AS f
  FROM mm x JOIN mm y ON x.site_id = y.site_id AND x.taxon_id = 1 AND y.taxon_id <> 1 JOIN positions p ON p.site_id = x.site_id),
  t AS (SELECT taxon_id, chrom, range, CAST(sum(CASE WHEN s OR f THEN 1 ELSE 0 END) AS BIGINT) AS sites, sum(CASE WHEN s THEN 1 ELSE 0 END) AS same, sum(CASE WHEN s AND f THEN 1 ELSE 0 END) AS het FROM o GROUP BY 1, 2, 3)
  SELECT taxon_id, chrom, range, sites, CASE WHEN sites > 0 THEN round(1 - (same - het / CAST(2 AS DOUBLE)) / sites, 9) END AS dist FROM t""")  # fmt: skip
def distance_to_taxon(spark, d):
    return quality.distance_to_taxon(geno(spark, d), positions(spark, d), 1, 2000).withColumn("dist", r9("dist"))


@query("top_taxa", WITH + "SELECT taxon_id, count(*) AS sites FROM geno g JOIN site s ON s.site_id = g.site_id WHERE a1 = major OR a2 = major GROUP BY 1 ORDER BY sites DESC, taxon_id LIMIT 5")
def top_taxa(spark, d):
    return quality.top_taxa(geno(spark, d), 5)


@query("mean_distance", WITH + _IBS + " SELECT round(avg(dist), 9) AS dist, round(avg(sites), 9) AS sites, count(*) AS pairs FROM dist WHERE dist IS NOT NULL")
def mean_distance(spark, d):
    return quality.mean_distance(pairs.ibs(geno(spark, d))).select(r9("dist").alias("dist"), r9("sites").alias("sites"), "pairs")


@query("cluster_distances", WITH + _IBS + " SELECT least(taxon_i % 3, taxon_j % 3) AS cluster_i, greatest(taxon_i % 3, taxon_j % 3) AS cluster_j, count(*) AS pairs, round(min(dist), 9) AS single, round(max(dist), 9) AS complete, round(avg(dist), 9) AS average FROM dist WHERE dist IS NOT NULL GROUP BY 1, 2")
def cluster_distances(spark, d):
    of = geno(spark, d).select("taxon_id").distinct().withColumn("cluster", F.pmod("taxon_id", F.lit(3)))
    return quality.cluster_distances(pairs.ibs(geno(spark, d)), of).select("cluster_i", "cluster_j", "pairs", *[r9(c).alias(c) for c in ("single", "complete", "average")])


@query("fill_distances", WITH + _IBS + ", x AS (SELECT taxon_i, taxon_j, CASE WHEN (taxon_i + taxon_j) % 5 <> 0 THEN dist END AS dist FROM dist) SELECT taxon_i, taxon_j, round(coalesce(dist, avg(dist) OVER ()), 9) AS dist FROM x")
def fill_distances(spark, d):
    x = pairs.ibs(geno(spark, d)).withColumn("dist", F.when((F.col("taxon_i") + F.col("taxon_j")) % 5 != 0, F.col("dist")))
    return pairs.fill_distances(x).withColumn("dist", r9("dist"))


@query("trait_distance", WITH + ", v AS (SELECT taxon_id, 't1' AS trait, t1 AS value FROM traits WHERE t1 IS NOT NULL UNION ALL SELECT taxon_id, 'f1', CAST(f1 AS DOUBLE) FROM traits) SELECT x.taxon_id AS taxon_i, y.taxon_id AS taxon_j, round(avg(abs(x.value - y.value)), 6) AS dist FROM v x JOIN v y ON x.trait = y.trait AND x.taxon_id < y.taxon_id GROUP BY 1, 2")
def trait_distance(spark, d):
    t = trait_view(spark, d).withColumn("f1", F.col("f1").cast("double"))
    return pairs.trait_distance(traits.long_form(t, ["t1", "f1"])).withColumn("dist", F.round("dist", 6))


@query("site_correlation", WITH + _HOM + " SELECT site_i, site_j, n, round(r, 9) AS r FROM corr")
def site_correlation(spark, d):
    return quality.site_correlation(geno(spark, d)).where("n > 0").withColumn("r", r9("r"))


@query("neighbor_correlation", WITH + _HOM + ", e AS (SELECT site_i AS site_id, abs(r) AS r FROM corr WHERE r IS NOT NULL AND site_j - site_i BETWEEN 10 AND 29 UNION ALL SELECT site_j, abs(r) FROM corr WHERE r IS NOT NULL AND site_j - site_i BETWEEN 10 AND 29) SELECT site_id, count(*) AS neighbors, round(avg(r), 9) AS mean_r FROM e GROUP BY 1")
def neighbor_correlation(spark, d):
    """The view has every site number from 0 on, so ranks are site numbers there."""
    return quality.neighbor_correlation(geno(spark, d), 20).withColumn("mean_r", r9("mean_r"))


@query("allele_shares", WITH + "SELECT r.site_id, allele, n, round(CAST(n AS DOUBLE) / gametes, 9) AS share FROM ranked r JOIN site s ON s.site_id = r.site_id")
def allele_shares(spark, d):
    return quality.allele_shares(geno(spark, d)).withColumn("share", r9("share"))
