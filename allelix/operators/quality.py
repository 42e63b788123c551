"""Error rates, reports over pairs and distances, correlations of sites, and divisions of chromosomes."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import is_het, is_missing
from .pairs import _n, _pairs, _words
from ..functions.tables import row_numbers, small
from .summary import allele_counts, site_stats


def ld_bins(ld: DataFrame, bins: int = 100) -> DataFrame:
    """Pairs by bin of r2 with their running share; pairs without r2 have a bin of their own (null) outside the shares. At most bins + 1 rows are ordered."""
    at = F.when(F.col("r2").isNotNull(), F.least(F.lit(bins - 1), F.floor(F.round("r2", 9) * bins))).cast("int")
    g = ld.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col("bin").isNotNull(), F.col("n"))
    share = F.sum(kept).over(Window.orderBy("bin")) / F.sum(kept).over(Window.partitionBy())
    return g.withColumn("share", F.when(F.col("bin").isNotNull(), share))


def mean_r2(ld: DataFrame) -> DataFrame:
    """Per site, the mean r2 over its pairs that have one."""
    sides = ld.where("r2 is not null").select(F.explode(F.array("site_i", "site_j")).alias("site_id"), "r2")
    return sides.groupBy("site_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg("r2").alias("mean_r2"))


def non_consensus(calls: DataFrame) -> DataFrame:
    """Per taxon, the share of called sites whose call holds another allele than the site's major one."""
    c = calls.where(~is_missing()).join(site_stats(calls).select("site_id", "major"), "site_id")
    other = (F.col("a1") != F.col("major")) | (F.col("a2") != F.col("major"))
    return c.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("called"), F.avg(other.cast("double")).alias("share"))


def duplicate_error(calls: DataFrame, names: DataFrame, ignore_hets: bool = True) -> DataFrame:
    """Samples whose names agree before ':', each with the next one in name order: sites that both called, and how many differ.

    names: taxon_id, name. One window over the samples of a line; calls meet by sample and site.
    """
    w = Window.partitionBy("line").orderBy("name", "taxon_id")
    p = names.withColumn("line", F.split("name", ":", 2)[0]).withColumn("taxon_j", F.lead("taxon_id").over(w))
    p = p.where("taxon_j is not null").select(F.col("taxon_id").alias("taxon_i"), "taxon_j")
    c = calls.where(~is_missing() & ~is_het() if ignore_hets else ~is_missing())
    c = c.select("taxon_id", "site_id", F.least("a1", "a2").alias("lo"), F.greatest("a1", "a2").alias("hi"))
    a = c.withColumnRenamed("taxon_id", "taxon_i").join(p, "taxon_i")
    b = c.select(F.col("taxon_id").alias("taxon_j"), "site_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    differ = ((F.col("lo") != F.col("lo2")) | (F.col("hi") != F.col("hi2"))).cast("long")
    g = a.join(b, ["taxon_j", "site_id"]).groupBy("taxon_i", "taxon_j").agg(F.count(F.lit(1)).alias("compared"), F.sum(differ).alias("differing"))
    return g.withColumn("rate", F.col("differing") / F.col("compared"))


def impute_major(calls: DataFrame) -> DataFrame:
    """Missing calls become homozygous for the site's major allele; sites without one stay missing."""
    c = calls.join(site_stats(calls).select("site_id", "major"), "site_id")
    fill = is_missing() & F.col("major").isNotNull()
    return c.select("taxon_id", "site_id", *[F.when(fill, F.col("major")).otherwise(F.col(a)).alias(a) for a in ("a1", "a2")])


def imputation_accuracy(truth: DataFrame, imputed: DataFrame, masked: DataFrame) -> DataFrame:
    """Masked cells (taxon_id, site_id) whose truth is known, by outcome: gap, unimputed, het (either call is heterozygous and they differ), correct, error."""
    key = ["taxon_id", "site_id"]
    pair = lambda df, n: df.select(*key, F.least("a1", "a2").alias(f"lo{n}"), F.greatest("a1", "a2").alias(f"hi{n}"))
    c = pair(truth.where(~is_missing()), 1).join(masked.select(*key).distinct(), key, "leftsemi").join(pair(imputed, 2), key)
    gap = (F.col("lo1") == 5) | (F.col("hi1") == 5) | (F.col("lo2") == 5) | (F.col("hi2") == 5)
    same = (F.col("lo1") == F.col("lo2")) & (F.col("hi1") == F.col("hi2"))
    het = (F.col("lo1") != F.col("hi1")) | (F.col("lo2") != F.col("hi2"))
    kind = F.when(F.col("lo2") == 15, "unimputed").when(gap, "gap").when(same, "correct").when(het, "het").otherwise("error")
    return c.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def segregating_count(calls: DataFrame, min_maf: float = 0.0) -> DataFrame:
    """Sites with a second allele whose share is at least min_maf."""
    return site_stats(calls).agg(F.count(F.lit(1)).alias("sites"), F.count_if((F.col("minor_n") > 0) & (F.col("maf") >= min_maf)).alias("segregating"))


def share_below(hist: DataFrame, cutoff: int) -> DataFrame:
    """hist: bin, n. Share of the counts in bins under the cutoff."""
    return hist.agg((F.coalesce(F.sum(F.when(F.col("bin") < cutoff, F.col("n"))), F.lit(0)) / F.sum("n")).alias("share"))


def kolmogorov_smirnov(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: bin, n. Largest difference of the running shares; histograms have few bins, which one window orders."""
    both = a.select("bin", F.col("n").alias("x"), F.lit(0).cast("long").alias("y")).union(b.select("bin", F.lit(0).cast("long"), "n"))
    g = both.groupBy("bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w, everything = Window.orderBy("bin"), Window.partitionBy()
    run = lambda k: F.sum(k).over(w) / F.sum(k).over(everything)
    return g.select(F.abs(run("x") - run("y")).alias("d")).agg(F.max("d").alias("d"))


def majority(calls: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per site, the commonest allele if chi-square tells the two commonest from equal counts at alpha, else null."""
    least = NormalDist().inv_cdf(1 - alpha / 2) ** 2
    s = site_stats(calls)
    chi2 = F.pow(F.col("major_n") - F.col("minor_n"), F.lit(2)) / (F.col("major_n") + F.col("minor_n"))
    return s.select("site_id", F.when(chi2 > least, F.col("major")).alias("allele"))


def blocks(positions: DataFrame, size: int) -> DataFrame:
    """Divides each chromosome into n // size blocks (one at least) of nearly equal numbers of sites, in order."""
    w = Window.partitionBy("chrom")
    i = F.row_number().over(w.orderBy("pos", "site_id")) - 1
    p = positions.withColumns({"__i": i, "__n": F.count(F.lit(1)).over(w)})
    parts = F.greatest(F.lit(1), F.floor(F.col("__n") / size))
    return p.withColumn("block", F.floor(F.col("__i") * parts / F.col("__n")).cast("int")).drop("__i", "__n")


def distance_to_taxon(calls: DataFrame, positions: DataFrame, taxon: int, width: int) -> DataFrame:
    """Identity-by-state distance of every other taxon to one, over successive ranges of `width` positions of a chromosome; null without shared sites."""
    s = site_stats(calls).select("site_id", "major", "minor")
    c = calls.join(s, "site_id").join(positions.select("site_id", "chrom", F.floor(F.col("pos") / width).cast("int").alias("range")), "site_id")
    has = lambda k: F.coalesce((F.col("a1") == F.col(k)) | (F.col("a2") == F.col(k)), F.lit(False))
    c = c.select("taxon_id", "site_id", "chrom", "range", has("major").alias("mj"), has("minor").alias("mn"))
    one = c.where(F.col("taxon_id") == taxon).select("site_id", F.col("mj").alias("mj1"), F.col("mn").alias("mn1"))
    c = c.where(F.col("taxon_id") != taxon).join(one, "site_id")
    same = (F.col("mj") & F.col("mj1")) | (F.col("mn") & F.col("mn1"))
    diff = (F.col("mj") & F.col("mn1")) | (F.col("mn") & F.col("mj1"))
    total = lambda x: F.sum(x.cast("long"))
    g = c.groupBy("taxon_id", "chrom", "range").agg(total(same).alias("same"), total(diff).alias("diff"), total(same & diff).alias("het"))
    sites = F.col("same") + F.col("diff") - F.col("het")
    return g.select("taxon_id", "chrom", "range", sites.alias("sites"), F.when(sites > 0, 1 - (F.col("same") - F.col("het") / 2) / sites).alias("dist"))


def top_taxa(calls: DataFrame, n: int) -> DataFrame:
    """The n taxa with most sites at which they hold the major allele; ties by taxon."""
    c = calls.join(site_stats(calls).select("site_id", "major"), "site_id").where("a1 = major or a2 = major")
    return c.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("sites")).orderBy(F.desc("sites"), "taxon_id").limit(n)


def mean_distance(dist: DataFrame) -> DataFrame:
    """Mean distance over the pairs that have one, and their mean number of sites."""
    return dist.where("dist is not null").agg(F.avg("dist").alias("dist"), F.avg("sites").alias("sites"), F.count(F.lit(1)).alias("pairs"))


def cluster_distances(dist: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters: taxon_id, cluster. Per pair of clusters (one with itself included) the least, largest and mean distance of their taxa."""
    clusters = small(clusters, 16)
    of = lambda k: clusters.select(F.col("taxon_id").alias(f"taxon_{k}"), F.col("cluster").alias(f"c_{k}"))
    d = dist.where("dist is not null").join(of("i"), "taxon_i").join(of("j"), "taxon_j")
    return d.groupBy(F.least("c_i", "c_j").alias("cluster_i"), F.greatest("c_i", "c_j").alias("cluster_j")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("dist").alias("single"), F.max("dist").alias("complete"), F.avg("dist").alias("average"))


def site_correlation(calls: DataFrame, near: int = 50) -> DataFrame:
    """r of the major allele's presence over taxa that are homozygous at both sites, for sites at most `near` apart; null under two taxa or without variance."""
    p = _pairs(_words(calls, "site_id", "taxon_id", True), "site_id", near)
    g = p.groupBy("i", "j").agg(*[_n(F.col(x + "1").bitwiseAND(F.col(y + "2"))).alias(x + y) for x in ("mj", "mn") for y in ("mj", "mn")])
    n = F.col("mjmj") + F.col("mjmn") + F.col("mnmj") + F.col("mnmn")
    x, y = F.col("mjmj") + F.col("mjmn"), F.col("mjmj") + F.col("mnmj")
    spread = (x * (n - x)).cast("double") * (y * (n - y))
    return g.select(F.col("i").alias("site_i"), F.col("j").alias("site_j"), n.alias("n"), F.when((n > 1) & (spread > 0), (n * F.col("mjmj") - x * y) / F.sqrt(spread)).alias("r"))


def neighbor_correlation(calls: DataFrame, window: int, start: int = 10) -> DataFrame:
    """Per site, the mean absolute correlation with `window` sites on each side, the first of them `start` places away; pairs without r are left out on both sides."""
    order = row_numbers(calls.select("site_id").distinct(), [F.col("site_id")], "rank").withColumn("rank", F.col("rank") - 1)
    ranked = calls.join(order, "site_id").select("taxon_id", F.col("rank").alias("site_id"), "a1", "a2")
    r = site_correlation(ranked, start + window - 1).where(F.col("r").isNotNull() & (F.col("site_j") - F.col("site_i") >= start))
    g = r.select(F.explode(F.array("site_i", "site_j")).alias("rank"), F.abs("r").alias("r")).groupBy("rank").agg(F.count(F.lit(1)).alias("neighbors"), F.avg("r").alias("mean_r"))
    return g.join(order, "rank").select("site_id", "neighbors", "mean_r")


def allele_shares(calls: DataFrame) -> DataFrame:
    """Per site and allele its count and its share of the site's alleles."""
    a = allele_counts(calls)
    return a.join(site_stats(calls).select("site_id", "gametes"), "site_id").select("site_id", "allele", "n", (F.col("n") / F.col("gametes")).alias("share"))


def contingency_permutations(tables: DataFrame, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """tables: id, counts (array of rows of counts). id, p: the share of tables with the same sums, drawn at random, that are at most as probable as the given one.

    Draws depend on the seed and the table's own counts only. A table under two rows or columns with counts has p 1; rows of unequal length are refused.
    """

    @F.pandas_udf("double")
    def p(counts: pd.Series) -> pd.Series:
        return pd.Series([_permuted(np.array([list(r) for r in t], np.int64), permutations, seed) for t in counts])

    return tables.select("id", p("counts").alias("p"))


def _permuted(t: np.ndarray, permutations: int, seed: int) -> float:
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]
    if min(t.shape) < 2:
        return 1.0
    rng = np.random.default_rng([seed, *map(int, t.ravel())])
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, t.sum() + 1)))])
    left, weight = np.tile(t.sum(axis=0), (permutations, 1)), np.zeros(permutations)
    for n in t.sum(axis=1):  # a row at a time from what the rows before have left of the columns
        row = np.zeros_like(left)
        rest = np.full(permutations, n)
        below = left.sum(axis=1)
        for c in range(left.shape[1] - 1):
            below = below - left[:, c]
            row[:, c] = rng.hypergeometric(left[:, c], below, rest)
            rest = rest - row[:, c]
        row[:, -1] = rest
        left = left - row
        weight += logs[row].sum(axis=1)
    return float((weight >= logs[t].sum() - 1e-9).mean())
