"""Counts and summaries of calls (taxon_id, site_id, a1, a2). Alleles rank by count, then by code; rare and missing states aren't alleles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import MISSING, RARE, is_het, is_missing

CODES = range(14)


def _n(cond):
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))



def site_stats(calls: DataFrame) -> DataFrame:
    """One row per site: taxa, called, hets, gametes, alleles (array of code and n by rank), major, major_n, minor, minor_n, maf, states. One shuffle of partial sums."""
    sums = [F.coalesce(F.sum((F.col("a1") == k).cast("long") + (F.col("a2") == k).cast("long")), F.lit(0).cast("long")).alias(f"n{k}") for k in CODES]
    rare = _n((F.col("a1") == RARE) | (F.col("a2") == RARE)).alias("rare")
    g = calls.groupBy("site_id").agg(F.count(F.lit(1)).alias("taxa"), _n(~is_missing()).alias("called"), _n(is_het()).alias("hets"), rare, *sums)
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"n{k}")).alias("o"), F.lit(k).alias("allele")) for k in CODES]), lambda s: s["o"] < 0))
    g = g.withColumn("alleles", F.transform(ranked, lambda s: F.struct(s["allele"].alias("allele"), (-s["o"]).alias("n"))))
    g = g.withColumn("gametes", reduce(lambda a, b: a + b, [F.col(f"n{k}") for k in CODES]))
    at = lambda i, f: F.get("alleles", F.lit(i))[f]
    zero = F.lit(0).cast("long")
    g = g.withColumns({"major": at(0, "allele"), "major_n": F.coalesce(at(0, "n"), zero), "minor": at(1, "allele"), "minor_n": F.coalesce(at(1, "n"), zero)})
    g = g.withColumns({"maf": F.when(F.col("gametes") > 0, F.col("minor_n") / F.col("gametes")), "states": F.size("alleles") + (F.col("rare") > 0).cast("int")})
    return g.select("site_id", "taxa", "called", "hets", "gametes", "alleles", "major", "major_n", "minor", "minor_n", "maf", "states")


def allele_counts(calls: DataFrame) -> DataFrame:
    return site_stats(calls).select("site_id", F.posexplode("alleles").alias("p", "x")).select("site_id", "x.allele", "x.n", (F.col("p") + 1).alias("rank"))


def taxa_stats(calls: DataFrame) -> DataFrame:
    gam = F.sum((F.col("a1") < MISSING).cast("long") + (F.col("a2") < MISSING).cast("long")).alias("gametes")
    return calls.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("sites"), _n(~is_missing()).alias("called"), _n(is_het()).alias("hets"), gam)


def diploid_counts(calls: DataFrame) -> DataFrame:
    """Unordered calls by site, ranked by count."""
    return calls.groupBy("site_id", F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")).agg(F.count(F.lit(1)).alias("n"))


def genotype_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("n"))


def major_minor_counts(calls: DataFrame) -> DataFrame:
    return site_stats(calls).groupBy("major", "minor").agg(F.count(F.lit(1)).alias("sites"))


def category_counts(calls: DataFrame) -> DataFrame:
    """Per site: called, hets, homozygous for the major and the minor allele, gaps (code 5). The site's ranks come by a join on site_id."""
    s = site_stats(calls).select("site_id", "major", "minor")
    hom = lambda k: F.coalesce((F.col("a1") == F.col("a2")) & (F.col("a1") == F.col(k)), F.lit(False))
    return calls.join(s, "site_id").groupBy("site_id").agg(
        _n(~is_missing()).alias("called"), _n(is_het()).alias("hets"), _n(hom("major")).alias("hom_major"), _n(hom("minor")).alias("hom_minor"), _n((F.col("a1") == 5) & (F.col("a2") == 5)).alias("gaps")
    )


def inbreeding(counts: DataFrame) -> DataFrame:
    """Adds maf and f = 1 - observed / expected heterozygosity; 1 where none is expected."""
    maf = F.when(F.col("called") > 0, (F.col("hom_minor") + F.col("hets") / 2) / F.col("called"))
    counts = counts.withColumn("maf", maf)
    expected = 2 * F.col("maf") * (1 - F.col("maf"))
    return counts.withColumn("f", F.when(expected > 0, 1 - F.col("hets") / F.col("called") / expected).otherwise(1.0))


def overall_summary(calls: DataFrame) -> DataFrame:
    """Sites, taxa and shares of missing and heterozygous calls over the table, one row per statistic."""
    one = calls.agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("site_id").alias("sites"), F.countDistinct("taxon_id").alias("taxa"), _n(is_missing()).alias("missing"), _n(is_het()).alias("hets")
    )
    d = lambda x: F.col(x).cast("double")
    one = one.select(d("sites").alias("sites"), d("taxa").alias("taxa"), d("calls").alias("calls"), d("missing").alias("missing"), d("hets").alias("hets"), (d("missing") / d("calls")).alias("share_missing"), (d("hets") / (d("calls") - d("missing"))).alias("share_het"))
    return one.unpivot([], one.columns, "stat", "value")


def frequency_distribution(calls: DataFrame) -> DataFrame:
    return site_stats(calls).groupBy("minor_n").agg(F.count(F.lit(1)).alias("sites"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and running share by bins of one width; values outside go to the outer bins."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / ((high - low) / bins)))).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def category_stats(df: DataFrame, category: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(category).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"))


def quartiles(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(category).agg(*[F.percentile(value, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
