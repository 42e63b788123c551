"""Queries over the genotype, position and trait views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encoding as enc
from ..operators import filters, joins, models, pairs, reads, summary, traits, windows
from .registry import query
from .views import WITH, geno, positions
from .views import traits as trait_view


def r9(x):
    return F.round(x, 9)


def rows(df: DataFrame) -> DataFrame:
    return df.select("taxon_id", "site_id", "a1", "a2")


@query("site_summary", WITH + """SELECT p.chrom, p.pos, p.snp_id, s.site_id, c.taxa, c.called, c.hets, s.gametes, s.major, s.major_n, s.minor, s.minor_n,
  round(CAST(s.minor_n AS DOUBLE) / s.gametes, 9) AS maf FROM site s JOIN site_calls c ON c.site_id = s.site_id JOIN positions p ON p.site_id = s.site_id
  WHERE s.gametes > 0 AND s.gametes >= 20 AND CAST(s.minor_n AS DOUBLE) / s.gametes BETWEEN 0.05 AND 0.5 ORDER BY chrom, pos""")  # fmt: skip
def site_summary(spark, d):
    s = summary.site_stats(geno(spark, d)).where((F.col("gametes") > 0) & (F.col("gametes") >= 20) & F.col("maf").between(0.05, 0.5))
    s = s.join(positions(spark, d), "site_id")
    return s.select("chrom", "pos", "snp_id", "site_id", "taxa", "called", "hets", "gametes", "major", "major_n", "minor", "minor_n", r9("maf").alias("maf")).orderBy("chrom", "pos")


@query("allele_ranks", WITH + "SELECT site_id, allele, n, rk AS rank FROM ranked")
def allele_ranks(spark, d):
    return summary.allele_counts(geno(spark, d)).select("site_id", "allele", "n", F.col("rank").cast("int").alias("rank"))


@query("taxa_summary", WITH + """SELECT taxon_id, count(*) AS sites, CAST(sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) AS BIGINT) AS called, CAST(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS BIGINT) AS hets,
  CAST(sum((CASE WHEN a1 < 15 THEN 1 ELSE 0 END) + (CASE WHEN a2 < 15 THEN 1 ELSE 0 END)) AS BIGINT) AS gametes FROM geno GROUP BY taxon_id""")  # fmt: skip
def taxa_summary(spark, d):
    return summary.taxa_stats(geno(spark, d))


@query("diploid_counts", WITH + "SELECT site_id, least(a1, a2) AS a1, greatest(a1, a2) AS a2, count(*) AS n FROM geno GROUP BY 1, 2, 3")
def diploid_counts(spark, d):
    return summary.diploid_counts(geno(spark, d))


@query("genotype_counts", WITH + "SELECT a1, a2, count(*) AS n FROM geno GROUP BY 1, 2")
def genotype_counts(spark, d):
    return summary.genotype_counts(geno(spark, d))


@query("major_minor_counts", WITH + "SELECT major, minor, count(*) AS sites FROM site GROUP BY 1, 2")
def major_minor_counts(spark, d):
    return summary.major_minor_counts(geno(spark, d))


@query("overall_summary", WITH + """, o AS (SELECT CAST(count(*) AS DOUBLE) AS calls, CAST(count(DISTINCT site_id) AS DOUBLE) AS sites, CAST(count(DISTINCT taxon_id) AS DOUBLE) AS taxa,
  CAST(sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 1 ELSE 0 END) AS DOUBLE) AS missing, CAST(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS DOUBLE) AS hets FROM geno)
  SELECT 'sites' AS stat, sites AS value FROM o UNION ALL SELECT 'taxa', taxa FROM o UNION ALL SELECT 'calls', calls FROM o UNION ALL SELECT 'missing', missing FROM o UNION ALL SELECT 'hets', hets FROM o
  UNION ALL SELECT 'share_missing', round(missing / calls, 9) FROM o UNION ALL SELECT 'share_het', round(hets / (calls - missing), 9) FROM o""")  # fmt: skip
def overall_summary(spark, d):
    return summary.overall_summary(geno(spark, d)).select("stat", r9("value").alias("value"))


CATEGORY = """, cat AS (SELECT g.site_id, CAST(sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) AS BIGINT) AS called, CAST(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS BIGINT) AS hets,
  CAST(sum(CASE WHEN a1 = a2 AND a1 = major THEN 1 ELSE 0 END) AS BIGINT) AS hom_major, CAST(sum(CASE WHEN a1 = a2 AND a1 = minor THEN 1 ELSE 0 END) AS BIGINT) AS hom_minor,
  CAST(sum(CASE WHEN a1 = 5 AND a2 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM geno g JOIN site s ON s.site_id = g.site_id GROUP BY g.site_id),
 f0 AS (SELECT *, CASE WHEN called > 0 THEN (hom_minor + hets / CAST(2 AS DOUBLE)) / called END AS maf FROM cat),
 f1 AS (SELECT *, CASE WHEN 2 * maf * (1 - maf) > 0 THEN 1 - CAST(hets AS DOUBLE) / called / (2 * maf * (1 - maf)) ELSE CAST(1 AS DOUBLE) END AS f FROM f0)
"""


@query("category_counts_f", WITH + CATEGORY + "SELECT site_id, called, hets, hom_major, hom_minor, gaps, round(maf, 9) AS maf, round(f, 9) AS f FROM f1")
def category_counts_f(spark, d):
    c = summary.inbreeding(summary.category_counts(geno(spark, d)))
    return c.select("site_id", "called", "hets", "hom_major", "hom_minor", "gaps", r9("maf").alias("maf"), r9("f").alias("f"))


@query("frequency_distribution", WITH + "SELECT minor_n, count(*) AS sites FROM site GROUP BY 1")
def frequency_distribution(spark, d):
    return summary.frequency_distribution(geno(spark, d))


@query("maf_histogram", WITH + "SELECT CAST(greatest(0, least(9, floor((CAST(minor_n AS DOUBLE) / gametes) / CAST(0.05 AS DOUBLE)))) AS INT) AS bin, count(*) AS n FROM site WHERE gametes > 0 GROUP BY 1")
def maf_histogram(spark, d):
    return summary.histogram(summary.site_stats(geno(spark, d)), "maf", 0.0, 0.5, 10)


@query("trait_by_factor", WITH + "SELECT f1, count(t1) AS n, round(avg(t1), 9) AS mean, round(stddev_samp(t1), 9) AS sd, round(stddev_samp(t1) / sqrt(count(t1)), 9) AS se FROM traits GROUP BY f1")
def trait_by_factor(spark, d):
    return summary.category_stats(trait_view(spark, d), "f1", "t1").select("f1", "n", *[r9(x).alias(x) for x in ("mean", "sd", "se")])


@query("trait_quartiles", WITH + "SELECT f1, round(quantile_cont(t1, 0.25), 9) AS q1, round(quantile_cont(t1, 0.5), 9) AS q2, round(quantile_cont(t1, 0.75), 9) AS q3 FROM traits GROUP BY f1")
def trait_quartiles(spark, d):
    return summary.quartiles(trait_view(spark, d), "f1", "t1").select("f1", *[r9(x).alias(x) for x in ("q1", "q2", "q3")])


def filtered(name: str, condition: str, fn, ctes: str = "", source: str = "geno"):
    @query(name, WITH + ctes + f"SELECT taxon_id, site_id, a1, a2 FROM {source} WHERE {condition}")
    def run(spark, d):
        return rows(fn(spark, d))

    return run


filtered("filter_sites_by_frequency", "site_id IN (SELECT site_id FROM site WHERE gametes > 0 AND gametes >= 20 AND CAST(minor_n AS DOUBLE) / gametes BETWEEN 0.2 AND 0.4)", lambda s, d: filters.sites_by_frequency(geno(s, d), 0.2, 0.4, 10))
filtered("filter_sites_in_range", "site_id IN (SELECT site_id FROM positions WHERE chrom = 2 AND pos BETWEEN 2000 AND 5000)", lambda s, d: filters.sites_in_range(geno(s, d), positions(s, d), 2, 2000, 5000))
filtered("filter_sites_by_name", "site_id IN (SELECT site_id FROM positions WHERE snp_id LIKE 'S_1%')", lambda s, d: filters.sites_by_name(geno(s, d), positions(s, d), positions(s, d).where("snp_id like 'S_1%'")))
filtered("filter_sites_not_named", "site_id NOT IN (SELECT site_id FROM positions WHERE snp_id LIKE 'S_1%')", lambda s, d: filters.sites_by_name(geno(s, d), positions(s, d), positions(s, d).where("snp_id like 'S_1%'"), keep=False))
filtered("filter_taxa", "taxon_id IN (SELECT taxon_id FROM traits WHERE f1 < 10)", lambda s, d: filters.taxa_by_list(geno(s, d), trait_view(s, d).where("f1 < 10")))
filtered("filter_taxa_excluded", "taxon_id NOT IN (SELECT taxon_id FROM traits WHERE f1 < 10)", lambda s, d: filters.taxa_by_list(geno(s, d), trait_view(s, d).where("f1 < 10"), keep=False))
filtered("filter_taxa_by_properties", "taxon_id IN (SELECT taxon_id FROM geno GROUP BY taxon_id HAVING sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE) >= 0.88 AND sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) AS DOUBLE) BETWEEN 0.1 AND 0.5)", lambda s, d: filters.taxa_by_properties(geno(s, d), 0.88, 0.1, 0.5))
filtered("filter_low_het_taxa", "taxon_id IN (SELECT taxon_id FROM geno GROUP BY taxon_id HAVING sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) >= 50 AND NOT sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN a1 = 15 AND a2 = 15 THEN 0 ELSE 1 END) AS DOUBLE) > 0.45)", lambda s, d: filters.low_het_taxa(geno(s, d), 0.45, 50))
filtered("filter_low_het_sites", "site_id IN (SELECT site_id FROM f1 WHERE f > 0.1 AND called >= 20 AND maf BETWEEN 0.05 AND 0.5)", lambda s, d: filters.low_het_sites(geno(s, d), 0.1, 20, 0.05, 0.5), CATEGORY)
filtered("hets_to_missing", "TRUE", lambda s, d: filters.hets_to_missing(geno(s, d)), source="(SELECT taxon_id, site_id, CASE WHEN a1 <> a2 THEN 15 ELSE a1 END AS a1, CASE WHEN a1 <> a2 THEN 15 ELSE a2 END AS a2 FROM geno)")
filtered("only_major_minor", "TRUE", lambda s, d: filters.only_major_minor(geno(s, d)), source="(SELECT taxon_id, g.site_id, CASE WHEN coalesce(a1 = major, FALSE) OR coalesce(a1 = minor, FALSE) THEN CASE WHEN coalesce(a2 = major, FALSE) OR coalesce(a2 = minor, FALSE) THEN a1 ELSE 15 END ELSE 15 END AS a1, CASE WHEN coalesce(a1 = major, FALSE) OR coalesce(a1 = minor, FALSE) THEN CASE WHEN coalesce(a2 = major, FALSE) OR coalesce(a2 = minor, FALSE) THEN a2 ELSE 15 END ELSE 15 END AS a2 FROM geno g JOIN site s ON s.site_id = g.site_id)")


@query("polymorphic_sites", WITH + "SELECT s.site_id FROM site s JOIN site_calls c ON c.site_id = s.site_id WHERE 1 - CAST(called AS DOUBLE) / taxa <= 0.12 AND coalesce(CAST(minor_n AS DOUBLE) / nullif(gametes, 0), 0) >= 0.1")
def polymorphic_sites(spark, d):
    return filters.polymorphic_sites(geno(spark, d), 0.12, 0.1)


@query("random_sites", WITH + ", k AS (SELECT DISTINCT site_id FROM geno) SELECT taxon_id, site_id, a1, a2 FROM geno WHERE site_id IN (SELECT site_id FROM k ORDER BY md5('7:' || site_id), site_id LIMIT 20)")
def random_sites(spark, d):
    """A sampling operator: 20 sites by a hash order."""
    return rows(filters.random_subset(geno(spark, d), "site_id", 20))


@query("stepwise_sites", WITH + ", k AS (SELECT DISTINCT site_id FROM geno), i AS (SELECT site_id, row_number() OVER (ORDER BY site_id) - 1 AS i, count(*) OVER () AS n FROM k) SELECT taxon_id, site_id, a1, a2 FROM geno WHERE site_id IN (SELECT site_id FROM i WHERE i % 4 = 0 AND n = 200)")
def stepwise_sites(spark, d):
    return rows(filters.stepwise_subset(geno(spark, d), "site_id", 0.25))


@query("taxa_by_name_part", WITH + "SELECT taxon_id, taxon FROM traits WHERE taxon LIKE '%01%' OR taxon LIKE '%7%'")
def taxa_by_name_part(spark, d):
    return filters.taxa_by_name_part(trait_view(spark, d), ["01", "7"]).select("taxon_id", "taxon")


@query("intersect_traits", WITH + "SELECT t.taxon_id, t.t1, t.f1, g.n FROM traits t JOIN (SELECT taxon_id, count(*) AS n FROM geno GROUP BY 1) g ON g.taxon_id = t.taxon_id")
def intersect_traits(spark, d):
    n = geno(spark, d).groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n"))
    return joins.combine_traits(trait_view(spark, d).drop("taxon"), n, union=False)


@query("union_traits", WITH + "SELECT coalesce(a.taxon_id, b.taxon_id) AS taxon_id, a.t1, b.t1 AS t1_2 FROM (SELECT taxon_id, t1 FROM traits WHERE f1 < 15) a FULL JOIN (SELECT taxon_id, t1 FROM traits WHERE f1 >= 10) b ON a.taxon_id = b.taxon_id")
def union_traits(spark, d):
    t = trait_view(spark, d)
    return joins.combine_traits(t.where("f1 < 15").select("taxon_id", "t1"), t.where("f1 >= 10").select("taxon_id", "t1"))


@query("common_taxa", WITH + "SELECT taxon_id FROM geno INTERSECT SELECT taxon_id FROM traits WHERE f1 < 12")
def common_taxa(spark, d):
    return joins.common_taxa(geno(spark, d), trait_view(spark, d).where("f1 < 12"))


@query("merge_calls", WITH + """, a AS (SELECT * FROM geno WHERE site_id < 120), b AS (SELECT taxon_id, site_id, CASE WHEN taxon_id % 2 = 0 THEN 15 ELSE 3 END AS a1, CASE WHEN taxon_id % 2 = 0 THEN 15 ELSE 3 END AS a2 FROM geno WHERE site_id >= 80)
  SELECT coalesce(a.taxon_id, b.taxon_id) AS taxon_id, coalesce(a.site_id, b.site_id) AS site_id, CASE WHEN b.a1 IS NULL OR (b.a1 = 15 AND a.a1 IS NOT NULL) THEN a.a1 ELSE b.a1 END AS a1, CASE WHEN b.a1 IS NULL OR (b.a1 = 15 AND a.a1 IS NOT NULL) THEN a.a2 ELSE b.a2 END AS a2
  FROM a FULL JOIN b ON a.taxon_id = b.taxon_id AND a.site_id = b.site_id""")  # fmt: skip
def merge_calls(spark, d):
    g = geno(spark, d)
    x = F.when(F.col("taxon_id") % 2 == 0, 15).otherwise(3)
    return joins.merge_calls(g.where("site_id < 120"), g.where("site_id >= 80").select("taxon_id", "site_id", x.alias("a1"), x.alias("a2")))


@query("merge_taxa_consensus", WITH + """, n AS (SELECT f1 AS name, site_id, allele, count(*) AS n FROM gametes g JOIN traits t ON t.taxon_id = g.taxon_id GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER w AS rk, sum(n) OVER (PARTITION BY name, site_id) AS total FROM n WINDOW w AS (PARTITION BY name, site_id ORDER BY n DESC, allele)),
  p AS (SELECT name, site_id, max(CASE WHEN rk = 1 THEN allele END) AS x, max(CASE WHEN rk = 2 THEN allele END) AS y, max(CASE WHEN rk = 1 THEN CAST(n AS DOUBLE) / total END) AS share FROM r GROUP BY 1, 2)
  SELECT name, site_id, x AS a1, CASE WHEN share > 0.8 OR y IS NULL THEN x ELSE y END AS a2 FROM p""")  # fmt: skip
def merge_taxa_consensus(spark, d):
    return joins.consensus(geno(spark, d), trait_view(spark, d).select("taxon_id", F.col("f1").alias("name")))


@query("compare_calls", WITH + """, b AS (SELECT taxon_id, site_id, CASE WHEN taxon_id % 3 = 0 THEN 2 ELSE a1 END AS b1, CASE WHEN taxon_id % 3 = 0 THEN 2 ELSE a2 END AS b2 FROM geno),
  j AS (SELECT g.site_id, (a1 < 15 AND b1 < 15) AS ok, (a1 = a2 AND b1 = b2 AND a1 < 15 AND b1 < 15) AS hom, (least(a1, a2) = least(b1, b2) AND greatest(a1, a2) = greatest(b1, b2)) AS same FROM geno g JOIN b ON b.taxon_id = g.taxon_id AND b.site_id = g.site_id)
  SELECT site_id, count(*) AS cells, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS compared, CAST(sum(CASE WHEN ok AND NOT same THEN 1 ELSE 0 END) AS BIGINT) AS mismatches,
  CAST(sum(CASE WHEN hom THEN 1 ELSE 0 END) AS BIGINT) AS hom_compared, CAST(sum(CASE WHEN hom AND NOT same THEN 1 ELSE 0 END) AS BIGINT) AS hom_mismatches FROM j GROUP BY site_id""")  # fmt: skip
def compare_calls(spark, d):
    g = geno(spark, d)
    x = lambda a: F.when(F.col("taxon_id") % 3 == 0, 2).otherwise(F.col(a)).alias(a)
    return joins.compare(g, g.select("taxon_id", "site_id", x("a1"), x("a2")))


@query("convert_coordinates", WITH + "SELECT site_id, snp_id, CASE WHEN site_id % 3 = 0 AND site_id % 2 = 0 THEN 9 ELSE chrom END AS chrom, CASE WHEN site_id % 3 = 0 AND site_id % 2 = 0 THEN pos + 7 ELSE pos END AS pos, site_id % 3 = 0 AND site_id % 2 = 0 AS converted FROM positions")
def convert_coordinates(spark, d):
    p = positions(spark, d)
    m = p.where("site_id % 3 = 0").select("snp_id", F.col("chrom").alias("old_chrom"), (F.col("pos") + F.col("site_id") % 2).alias("old_pos"), F.lit(9).alias("new_chrom"), (F.col("pos") + 7).alias("new_pos"))
    return joins.convert_coordinates(p, m)


@query("nearest_site", WITH + ", q AS (SELECT chrom, pos + 60 AS pos FROM positions) SELECT q.chrom, q.pos, (SELECT arg_max(p.site_id, p.pos) FROM positions p WHERE p.chrom = q.chrom AND p.pos <= q.pos) AS site_before FROM q")
def nearest_site(spark, d):
    p = positions(spark, d)
    return joins.nearest_site(p.select("chrom", (F.col("pos") + 60).alias("pos")), p)


@query("segment_range_join", WITH + ", s AS (SELECT taxon_id, 1 + taxon_id % 4 AS chrom, 1000 + taxon_id * 13 AS a, 4000 + taxon_id * 13 AS b FROM traits) SELECT s.taxon_id, p.site_id FROM s JOIN positions p ON p.chrom = s.chrom AND p.pos BETWEEN s.a AND s.b")
def segment_range_join(spark, d):
    s = trait_view(spark, d).select("taxon_id", (1 + F.col("taxon_id") % 4).alias("chrom"), (1000 + F.col("taxon_id") * 13).alias("start"), (4000 + F.col("taxon_id") * 13).alias("end"))
    return joins.segments_to_sites(s, positions(spark, d), 1 << 12).select("taxon_id", "site_id")


HOM = ", h AS (SELECT *, lag(a1) OVER w AS p, lead(a1) OVER w AS n FROM geno WHERE a1 = a2 AND a1 < 15 WINDOW w AS (PARTITION BY taxon_id ORDER BY site_id))"


@query("crossovers", WITH + HOM + "SELECT taxon_id, count(*) AS informative, CAST(sum(CASE WHEN p IS NULL OR p <> a1 THEN 1 ELSE 0 END) AS BIGINT) AS crossovers FROM h GROUP BY 1")
def crossovers(spark, d):
    return windows.crossovers(geno(spark, d))


@query("double_crossovers", WITH + HOM + "SELECT site_id, count(*) AS informative, CAST(sum(CASE WHEN p = n AND a1 <> p THEN 1 ELSE 0 END) AS BIGINT) AS double_crossovers FROM h GROUP BY 1")
def double_crossovers(spark, d):
    return windows.double_crossovers(geno(spark, d), "site_id")


@query("fill_gaps", WITH + """, c AS (SELECT taxon_id, site_id, CASE WHEN a1 < 15 THEN a1 * 16 + a2 END AS x FROM geno),
  w AS (SELECT taxon_id, site_id, x, last_value(x IGNORE NULLS) OVER (PARTITION BY taxon_id ORDER BY site_id) AS p, first_value(x IGNORE NULLS) OVER (PARTITION BY taxon_id ORDER BY site_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM c),
  y AS (SELECT taxon_id, site_id, coalesce(x, CASE WHEN p = n THEN p END, 255) AS v FROM w) SELECT taxon_id, site_id, CAST(v // 16 AS INT) AS a1, CAST(v % 16 AS INT) AS a2 FROM y""")  # fmt: skip
def fill_gaps(spark, d):
    return windows.fill_gaps(geno(spark, d))


@query("sliding_diversity", WITH + """, i AS (SELECT s.site_id, row_number() OVER (ORDER BY s.site_id) - 1 AS i, count(*) OVER () AS total, called,
    CASE WHEN gametes > 1 THEN CAST(gametes AS DOUBLE) / (gametes - 1) * (1 - (CAST(major_n AS DOUBLE) / gametes) * (CAST(major_n AS DOUBLE) / gametes) - (CAST(minor_n AS DOUBLE) / gametes) * (CAST(minor_n AS DOUBLE) / gametes)) ELSE 0 END AS h,
    CASE WHEN (SELECT count(*) FROM allele_n a WHERE a.site_id = s.site_id) > 1 THEN 1 ELSE 0 END AS poly FROM site s JOIN site_calls c ON c.site_id = s.site_id),
  w AS (SELECT range * 10 AS start FROM range(0, 400)), g AS (SELECT w.start, count(*) AS sites, CAST(sum(poly) AS BIGINT) AS seg, sum(h) AS pi, CAST(sum(called) AS DOUBLE) / count(*) AS n FROM i JOIN w ON i.i BETWEEN w.start AND w.start + 19 WHERE w.start < i.total - 20 GROUP BY w.start),
  a AS (SELECT *, list_sum([CAST(1 AS DOUBLE) / x for x in range(1, greatest(2, CAST(ceil(n) AS INT)))]) AS a1, list_sum([CAST(1 AS DOUBLE) / (x * x) for x in range(1, greatest(2, CAST(ceil(n) AS INT)))]) AS a2 FROM g),
  e AS (SELECT *, ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 AS e1, (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM a)
  SELECT CAST(start AS BIGINT) AS start, CAST(start + 19 AS BIGINT) AS "end", sites, seg, round(n, 6) AS n, round(pi, 6) AS pi, round(seg / a1, 6) AS theta, round(CASE WHEN seg > 0 THEN (pi - seg / a1) / sqrt(e1 * seg + e2 * seg * (seg - 1)) END, 6) AS tajima_d FROM e""")  # fmt: skip
def sliding_diversity(spark, d):
    w = windows.sliding_diversity(geno(spark, d), 20, 10)
    return w.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "sites", "seg", *[F.round(x, 6).alias(x) for x in ("n", "pi", "theta", "tajima_d")])


@query("position_islands", WITH + ", g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) > 137 THEN 1 ELSE 0 END AS b FROM positions) SELECT chrom, pos, snp_id, site_id, CAST(sum(b) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS island FROM g")
def position_islands(spark, d):
    return windows.islands(positions(spark, d), "chrom", "pos", 137).select("chrom", "pos", "snp_id", "site_id", F.col("island").cast("long").alias("island"))


IBS = """, b AS (SELECT g.taxon_id, g.site_id, coalesce(a1 = major OR a2 = major, FALSE) AS mj, coalesce(a1 = minor OR a2 = minor, FALSE) AS mn FROM geno g JOIN site s ON s.site_id = g.site_id),
 q AS (SELECT x.taxon_id AS taxon_i, y.taxon_id AS taxon_j, (x.mj AND y.mj) OR (x.mn AND y.mn) AS same, (x.mj AND y.mn) OR (x.mn AND y.mj) AS diff FROM b x JOIN b y ON x.site_id = y.site_id AND x.taxon_id < y.taxon_id),
 t AS (SELECT taxon_i, taxon_j, sum(CASE WHEN same THEN 1 ELSE 0 END) AS s, sum(CASE WHEN diff THEN 1 ELSE 0 END) AS d, sum(CASE WHEN same AND diff THEN 1 ELSE 0 END) AS h FROM q GROUP BY 1, 2),
 dist AS (SELECT taxon_i, taxon_j, CASE WHEN s + d - h > 0 THEN 1 - (s - h / CAST(2 AS DOUBLE)) / (s + d - h) END AS dist, CAST(s + d - h AS BIGINT) AS sites FROM t) """


@query("ibs_distance", WITH + IBS + "SELECT taxon_i, taxon_j, round(dist, 9) AS dist, sites FROM dist")
def ibs_distance(spark, d):
    return pairs.ibs(geno(spark, d)).select("taxon_i", "taxon_j", r9("dist").alias("dist"), "sites")


@query("kinship_from_ibs", WITH + IBS + ", k AS (SELECT *, 2 - dist AS s, min(2 - dist) OVER () AS low FROM dist WHERE dist IS NOT NULL) SELECT taxon_i, taxon_j, round((s - low) * 2 / (2 - low), 9) AS k FROM k")
def kinship_from_ibs(spark, d):
    return pairs.kinship_from_ibs(pairs.ibs(geno(spark, d))).select("taxon_i", "taxon_j", r9("k").alias("k"))


@query("ld_sliding_window", WITH + """, b AS (SELECT g.taxon_id, g.site_id, coalesce(a1 = major OR a2 = major, FALSE) AS mj, coalesce(a1 = minor OR a2 = minor, FALSE) AS mn FROM geno g JOIN site s ON s.site_id = g.site_id),
  t AS (SELECT x.site_id AS i, y.site_id AS j, CAST(sum(CASE WHEN x.mj AND y.mj THEN 1 ELSE 0 END) AS DOUBLE) AS jj, CAST(sum(CASE WHEN x.mj AND y.mn THEN 1 ELSE 0 END) AS DOUBLE) AS jn, CAST(sum(CASE WHEN x.mn AND y.mj THEN 1 ELSE 0 END) AS DOUBLE) AS nj, CAST(sum(CASE WHEN x.mn AND y.mn THEN 1 ELSE 0 END) AS DOUBLE) AS nn
    FROM b x JOIN b y ON x.taxon_id = y.taxon_id AND y.site_id BETWEEN x.site_id + 1 AND x.site_id + 50 GROUP BY 1, 2),
  v AS (SELECT *, jj + jn + nj + nn AS n FROM t), u AS (SELECT *, (jj + jn) / n AS pa, (jj + nj) / n AS pb, jj / n - ((jj + jn) / n) * ((jj + nj) / n) AS d FROM v WHERE n > 0),
  z AS (SELECT *, n >= 20 AND nn + nj >= 2 AND nn + jn >= 2 AND pa > 0 AND pa < 1 AND pb > 0 AND pb < 1 AS fine, CASE WHEN d < 0 THEN least(pa * pb, (1 - pa) * (1 - pb)) ELSE least(pa * (1 - pb), (1 - pa) * pb) END AS m FROM u)
  SELECT i AS site_i, j AS site_j, CAST(n AS BIGINT) AS n, CASE WHEN fine THEN round(d * d / (pa * (1 - pa) * pb * (1 - pb)), 9) END AS r2, CASE WHEN fine AND m > 0 THEN round(abs(d) / m, 9) END AS d_prime FROM z""")  # fmt: skip
def ld_sliding_window(spark, d):
    return pairs.ld(geno(spark, d), 50).where("n > 0").select("site_i", "site_j", "n", r9("r2").alias("r2"), r9("d_prime").alias("d_prime"))


@query("ld_fisher")
def ld_fisher(spark, d):
    return models.with_fisher(pairs.ld(geno(spark, d)))


@query("kinship", WITH + """, al AS (SELECT r.site_id, r.allele, CAST(r.n AS DOUBLE) / s.gametes AS p FROM ranked r JOIN site s ON s.site_id = r.site_id WHERE rk < (SELECT max(rk) FROM ranked q WHERE q.site_id = r.site_id)),
  w AS (SELECT taxon_id, g.site_id, allele, (CASE WHEN a1 = allele THEN 1 ELSE 0 END) + (CASE WHEN a2 = allele THEN 1 ELSE 0 END) - 2 * p AS w FROM geno g JOIN al ON al.site_id = g.site_id WHERE a1 < 14 AND a2 < 14)
  SELECT x.taxon_id AS taxon_i, y.taxon_id AS taxon_j, round(sum(x.w * y.w) / (SELECT 2 * sum(p * (1 - p)) FROM al), 6) AS k FROM w x JOIN w y ON x.site_id = y.site_id AND x.allele = y.allele AND x.taxon_id <= y.taxon_id GROUP BY 1, 2""")  # fmt: skip
def kinship(spark, d):
    return pairs.kinship(geno(spark, d)).select("taxon_i", "taxon_j", F.round("k", 6).alias("k"))


@query("collapsed_numeric", WITH + "SELECT taxon_id, g.site_id, CASE WHEN NOT (a1 = 15 AND a2 = 15) THEN CAST(1 - (CASE WHEN a1 = major THEN 0.5 ELSE 0 END) - (CASE WHEN a2 = major THEN 0.5 ELSE 0 END) AS DOUBLE) END AS value FROM geno g JOIN site s ON s.site_id = g.site_id")
def collapsed_numeric(spark, d):
    return traits.collapsed(geno(spark, d))


@query("standardized_traits", WITH + "SELECT taxon_id, 't1' AS trait, round((t1 - (SELECT avg(t1) FROM traits)) / (SELECT stddev_samp(t1) FROM traits), 9) AS value FROM traits")
def standardized_traits(spark, d):
    return traits.standardize(traits.long_form(trait_view(spark, d), ["t1"])).select("taxon_id", "trait", r9("value").alias("value"))


@query("log_traits", WITH + "SELECT taxon_id, 't1' AS trait, CASE WHEN t1 > 0.000001 THEN round(log10(t1), 5) END AS value FROM traits")
def log_traits(spark, d):
    return traits.transform(traits.long_form(trait_view(spark, d), ["t1"]), "log10")


@query("missing_share", WITH + "SELECT 't1' AS trait, round(avg(CASE WHEN t1 IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS missing FROM traits")
def missing_share(spark, d):
    return traits.missing_share(traits.long_form(trait_view(spark, d), ["t1"])).select("trait", r9("missing").alias("missing"))


@query("knn_impute", WITH + """, v AS (SELECT taxon_id, 't1' AS trait, t1 AS value FROM traits UNION ALL SELECT taxon_id, 'f1', CAST(f1 AS DOUBLE) FROM traits),
  d AS (SELECT x.taxon_id AS i, y.taxon_id AS j, avg(abs(x.value - y.value)) AS dist FROM v x JOIN v y ON x.trait = y.trait AND x.taxon_id <> y.taxon_id WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2),
  n AS (SELECT g.taxon_id, g.trait, h.value, row_number() OVER (PARTITION BY g.taxon_id, g.trait ORDER BY dist, j) AS r FROM v g JOIN d ON d.i = g.taxon_id JOIN v h ON h.taxon_id = d.j AND h.trait = g.trait WHERE g.value IS NULL AND h.value IS NOT NULL)
  SELECT v.taxon_id, v.trait, round(coalesce(v.value, m.value), 6) AS value FROM v LEFT JOIN (SELECT taxon_id, trait, avg(value) AS value FROM n WHERE r <= 3 GROUP BY 1, 2) m ON m.taxon_id = v.taxon_id AND m.trait = v.trait""")  # fmt: skip
def knn_impute(spark, d):
    return traits.knn_impute(traits.long_form(trait_view(spark, d), ["t1", "f1"]), 3).withColumn("value", F.round("value", 6))


@query("glm_association")
def glm_association(spark, d):
    v = trait_view(spark, d).select("taxon_id", F.lit("t1").alias("trait"), F.col("t1").alias("value"))
    return models.glm(geno(spark, d), v)


@query("viterbi_impute")
def viterbi_impute(spark, d):
    return models.viterbi_impute(geno(spark, d), positions(spark, d))


@query("hapmap_letters", WITH + """SELECT taxon_id, site_id, CASE WHEN a1 = a2 THEN CASE a1 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' ELSE 'N' END
  ELSE CASE least(a1, a2) * 16 + greatest(a1, a2) WHEN 1 THEN 'M' WHEN 2 THEN 'R' WHEN 3 THEN 'W' WHEN 18 THEN 'S' WHEN 19 THEN 'Y' WHEN 35 THEN 'K' ELSE 'N' END END AS letter FROM geno""")  # fmt: skip
def hapmap_letters(spark, d):
    return geno(spark, d).select("taxon_id", "site_id", enc.iupac().alias("letter"))


@query("manhattan_offsets", WITH + ", e AS (SELECT chrom, max(pos) AS m FROM positions GROUP BY 1), o AS (SELECT chrom, coalesce(sum(m) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM e) SELECT p.site_id, CAST(p.pos + off AS BIGINT) AS at, round(-log10((p.site_id + 1) / CAST(1000 AS DOUBLE)), 9) AS observed FROM positions p JOIN o ON o.chrom = p.chrom")
def manhattan_offsets(spark, d):
    p = positions(spark, d).withColumn("p", (F.col("site_id") + 1) / F.lit(1000.0))
    return windows.manhattan(p, "p").select("site_id", F.col("at").cast("long").alias("at"), r9("observed").alias("observed"))


@query("qq_expected", WITH + ", r AS (SELECT site_id, row_number() OVER (ORDER BY (site_id + 1) / CAST(1000 AS DOUBLE)) AS k, count(*) OVER () AS n, (site_id + 1) / CAST(1000 AS DOUBLE) AS p FROM positions) SELECT site_id, round(-log10(CAST(k AS DOUBLE) / n), 9) AS expected, round(-log10(p), 9) AS observed FROM r")
def qq_expected(spark, d):
    return windows.qq(positions(spark, d).withColumn("p", (F.col("site_id") + 1) / F.lit(1000.0)), "p").select("site_id", r9(F.col("expected") + 0.0).alias("expected"), r9("observed").alias("observed"))


@query("calls_by_depth")
def calls_by_depth(spark, d):
    x = geno(spark, d).select("taxon_id", "site_id", F.array(*[(F.pmod(F.col("taxon_id") * (k + 3) + F.col("site_id") * (k + 1), F.lit(5 + 9 * k)) * (F.col("a1") == k).cast("int") + (F.col("a2") == k).cast("int")).cast("int") for k in range(4)]).alias("depth"))
    return reads.call_by_depth(x, 100)


@query("separated_numeric", WITH + ", g AS (SELECT site_id, least(a1, a2) AS c1, greatest(a1, a2) AS c2, count(*) AS n FROM geno WHERE a1 < 14 AND a2 < 14 GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n, c1, c2) AS cls FROM g) SELECT x.taxon_id, x.site_id, CAST(cls AS INT) AS cls, CASE WHEN a1 < 14 THEN CASE WHEN least(a1, a2) = c1 AND greatest(a1, a2) = c2 THEN 1 ELSE 0 END END AS value FROM geno x JOIN k ON k.site_id = x.site_id")
def separated_numeric(spark, d):
    return traits.separated(geno(spark, d))


@query("orders_by_segment", "SELECT c_mktsegment, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def orders_by_segment(spark, d):
    """Spark-native coverage: join and aggregation over the driver's tables."""
    o, c = (spark.read.parquet(f"{d.rstrip('/')}/{t}.parquet") for t in ("orders", "customer"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("event_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b, event_id FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY 1, 2")
def event_sessions(spark, d):
    """Spark-native coverage: sessions of events with gaps over 30 minutes between them."""
    e = spark.read.parquet(f"{d.rstrip('/')}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    return e.withColumn("b", b).withColumn("session", F.sum("b").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


_LOGS = ", l AS (SELECT s.site_id, minor_n * ln(0.002) + major_n * ln(0.998) AS e, minor_n * ln(0.25) + major_n * ln(0.75) AS q, minor_n * ln(0.5) + major_n * ln(0.5) AS h FROM site s JOIN site_calls c ON c.site_id = s.site_id WHERE minor_n > 0 AND 1 - CAST(called AS DOUBLE) / taxa <= 0.2) "


@query("segregating_sites", WITH + _LOGS + "SELECT site_id FROM l WHERE exp(e - h) + exp(q - h) < 0.5")
def segregating_sites(spark, d):
    return filters.segregating_sites(geno(spark, d), 0.2)


@query("segregating_sites_backcross", WITH + _LOGS + "SELECT site_id FROM l WHERE q > h AND q > e")
def segregating_sites_backcross(spark, d):
    return filters.segregating_sites(geno(spark, d), 0.2, 0.25)


@query("haplotype_distance", WITH + """, k AS (SELECT taxon_id, site_id, least(a1, a2) AS lo, greatest(a1, a2) AS hi FROM geno WHERE a1 < 14 AND a2 < 14)
  SELECT x.taxon_id AS taxon_i, y.taxon_id AS taxon_j, CAST(sum(CASE WHEN x.lo = y.lo AND x.hi = y.hi THEN 0 WHEN x.lo <> x.hi OR y.lo <> y.hi THEN 1 ELSE 2 END) AS BIGINT) AS dist
  FROM k x JOIN k y ON x.site_id // 64 = y.site_id // 64 AND x.taxon_id < y.taxon_id AND x.site_id = y.site_id GROUP BY 1, 2""")  # fmt: skip
def haplotype_distance(spark, d):
    return pairs.haplotype_distance(geno(spark, d))


@query("stepwise_association")
def stepwise_association(spark, d):
    v = trait_view(spark, d).select("taxon_id", F.col("t1").alias("value"))
    return models.stepwise(geno(spark, d), v, 0.05, 0.1)
