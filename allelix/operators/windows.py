"""Ordered computations over sites or taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import MISSING, is_het, is_missing
from ..functions.tables import row_numbers, running
from .summary import site_stats


def diversity(stats: DataFrame) -> DataFrame:
    """pi, theta and Tajima's D from one row per group: n (real sample size), sites, seg, pi_sum (sum of pairwise diversity)."""
    a1 = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil("n").cast("int") - 1)), F.lit(0.0), lambda a, i: a + 1.0 / i)
    a2 = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil("n").cast("int") - 1)), F.lit(0.0), lambda a, i: a + 1.0 / (i.cast("double") * i))
    s = stats.withColumns({"a1": a1, "a2": a2})
    n, x1, x2, seg = F.col("n"), F.col("a1"), F.col("a2"), F.col("seg")
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / x1, b2 - (n + 2) / (x1 * n) + x2 / (x1 * x1)
    e1, e2 = c1 / x1, c2 / (x1 * x1 + x2)
    d = (F.col("pi") - seg / x1) / F.sqrt(e1 * seg + e2 * seg * (seg - 1))
    return s.withColumns({"theta": seg / x1, "theta_per_site": seg / x1 / F.col("sites"), "pi_per_site": F.col("pi") / F.col("sites"), "tajima_d": F.when(seg > 0, d)})


def sliding_diversity(calls: DataFrame, window: int = 20, step: int = 10, include_last: bool = False) -> DataFrame:
    """By site index: windows of `window` sites at each step; the last full window is left out unless include_last. Sites are exploded to the windows that cover them, so windows are groups."""
    s = row_numbers(site_stats(calls), [F.col("site_id")], "i").withColumn("i", F.col("i") - 1)
    total = F.lit(s.count())
    p = F.col("major_n") / F.col("gametes")
    q = F.col("minor_n") / F.col("gametes")
    n = F.col("gametes")
    s = s.withColumns({"total": total, "h": F.when(n > 1, n / (n - 1) * (1 - p * p - q * q)).otherwise(0.0), "poly": (F.col("states") > 1).cast("long")})
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (window - 1)) / step)).cast("int")
    s = s.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("i") / step).cast("int"))))
    limit = F.col("start") <= F.col("total") - window if include_last else F.col("start") < F.col("total") - window
    g = s.withColumn("start", F.col("w") * step).where(limit).groupBy("start").agg(F.count(F.lit(1)).alias("sites"), F.sum("poly").alias("seg"), F.sum("h").alias("pi"), (F.sum("called") / F.count(F.lit(1))).alias("n"))
    return diversity(g).select("start", (F.col("start") + window - 1).alias("end"), "sites", "seg", "n", "pi", "theta", "tajima_d")


def crossovers(calls: DataFrame) -> DataFrame:
    """Per taxon, over homozygous calls: changes of state; the first informative call counts as one."""
    w = Window.partitionBy("taxon_id").orderBy("site_id")
    c = calls.where(~is_missing() & ~is_het()).withColumn("before", F.lag("a1").over(w))
    return c.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("informative"), F.sum((F.col("before").isNull() | (F.col("before") != F.col("a1"))).cast("long")).alias("crossovers"))


def double_crossovers(calls: DataFrame, by: str = "taxon_id") -> DataFrame:
    """Calls that differ from equal neighbours, among homozygous calls of a taxon; counted by taxon or site."""
    w = Window.partitionBy("taxon_id").orderBy("site_id")
    c = calls.where(~is_missing() & ~is_het()).withColumns({"p": F.lag("a1").over(w), "n": F.lead("a1").over(w)})
    hit = F.coalesce((F.col("p") == F.col("n")) & (F.col("a1") != F.col("p")), F.lit(False))
    return c.groupBy(by).agg(F.count(F.lit(1)).alias("informative"), F.sum(hit.cast("long")).alias("double_crossovers"))


def fill_gaps(calls: DataFrame) -> DataFrame:
    """Missing cells between equal flanking calls of a taxon take that call; observed calls stay."""
    w = Window.partitionBy("taxon_id").orderBy("site_id")
    call = F.when(~is_missing(), F.struct("a1", "a2"))
    c = calls.withColumns({"x": call})
    c = c.withColumns({"p": F.last("x", ignorenulls=True).over(w), "n": F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    new = F.coalesce("x", F.when(F.col("p") == F.col("n"), F.col("p")), F.struct(F.lit(MISSING).alias("a1"), F.lit(MISSING).alias("a2")))
    return c.select("taxon_id", "site_id", new["a1"].alias("a1"), new["a2"].alias("a2"))


def islands(df: DataFrame, group: str, position: str, border: int) -> DataFrame:
    """Numbers runs of positions whose gaps are at most border."""
    w = Window.partitionBy(group).orderBy(position)
    gap = F.coalesce(F.col(position) - F.lag(position).over(w) > border, F.lit(False)).cast("int")
    return df.withColumn("__g", gap).withColumn("island", F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__g")


def qq(df: DataFrame, p: str) -> DataFrame:
    """Expected and observed -log10 of ranked p-values; ranks by ranges of p."""
    r = row_numbers(df.where(F.col(p) > 0), [F.col(p)], "rank")
    return r.withColumns({"expected": -F.log10(F.col("rank") / r.count()), "observed": -F.log10(p)})


def manhattan(df: DataFrame, p: str) -> DataFrame:
    """Cumulative position over chromosomes; one row per chromosome is summed up and joined back."""
    ends = df.groupBy("chrom").agg(F.max("pos").alias("end"))
    w = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    at = ends.select("chrom", F.coalesce(F.sum("end").over(w), F.lit(0)).alias("offset"))
    return df.join(F.broadcast(at), "chrom").withColumns({"at": F.col("pos") + F.col("offset"), "observed": -F.log10(p)}).drop("offset")


def rank_of_null(df: DataFrame, null: DataFrame, p: str) -> DataFrame:
    """Share of the null distribution's minimum p-values that are at most p, by running counts over ranges of both."""
    both = df.select("id", F.col(p).alias("p"), F.lit(1).alias("k")).unionByName(null.select(F.lit(None).cast("long").alias("id"), F.col(p).alias("p"), F.lit(0).alias("k")))
    told = running(both, [F.col("p"), F.col("k")], {"le": (F.col("k") == 0).cast("long")})
    return told.where("k = 1").select("id", "p", (F.col("le") / null.count()).alias("p_genome"))
