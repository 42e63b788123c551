"""Filters of sites, taxa and calls. All keep the shape of calls; lists of ids or names are DataFrames, joined and never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import MISSING, is_het
from ..functions.tables import row_numbers
from .summary import category_counts, inbreeding, site_stats, taxa_stats


def sites_by_frequency(calls: DataFrame, low: float = 0.0, high: float = 1.0, min_count: int = 0) -> DataFrame:
    """Sites with gametes, at least 2 * min_count of them, and minor share of the gametes within [low, high]."""
    s = site_stats(calls).where((F.col("gametes") > 0) & (F.col("gametes") >= 2 * min_count) & F.col("maf").between(low, high))
    return calls.join(s.select("site_id"), "site_id", "leftsemi")


def sites_in_range(calls: DataFrame, positions: DataFrame, chrom=None, start: int | None = None, end: int | None = None) -> DataFrame:
    p = positions
    if chrom is not None:
        p = p.where(F.col("chrom") == chrom)
    if start is not None:
        p = p.where(F.col("pos") >= start)
    if end is not None:
        p = p.where(F.col("pos") <= end)
    return calls.join(p.select("site_id"), "site_id", "leftsemi")


def sites_by_name(calls: DataFrame, positions: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    named = positions.join(names.select("snp_id"), "snp_id", "leftsemi").select("site_id")
    return calls.join(named, "site_id", "leftsemi" if keep else "leftanti")


def taxa_by_list(calls: DataFrame, taxa: DataFrame, keep: bool = True, retain_unknown: bool = False) -> DataFrame:
    """retain_unknown: listed taxa without calls get a missing call at every site."""
    kept = calls.join(taxa.select("taxon_id"), "taxon_id", "leftsemi" if keep else "leftanti")
    if keep and retain_unknown:
        new = taxa.select("taxon_id").distinct().join(calls, "taxon_id", "leftanti")
        sites = calls.select("site_id").distinct().withColumn("__all", F.lit(1))
        kept = kept.unionByName(new.withColumn("__all", F.lit(1)).join(sites, "__all").select("taxon_id", "site_id", F.lit(MISSING).alias("a1"), F.lit(MISSING).alias("a2")))
    return kept


def taxa_by_name_part(taxa: DataFrame, parts: list[str], keep: bool = True, column: str = "taxon") -> DataFrame:
    found = F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.col(column), p))
    return taxa.where(found if keep else ~found)


def taxa_by_properties(calls: DataFrame, min_present: float = 0.0, min_het: float = 0.0, max_het: float = 1.0) -> DataFrame:
    t = taxa_stats(calls)
    het = F.when(F.col("called") > 0, F.col("hets") / F.col("called")).otherwise(0.0)
    t = t.where((F.col("called") / F.col("sites") >= min_present) & het.between(min_het, max_het))
    return calls.join(t.select("taxon_id"), "taxon_id", "leftsemi")


def low_het_taxa(calls: DataFrame, max_het: float, min_count: int) -> DataFrame:
    t = taxa_stats(calls).where((F.col("called") >= min_count) & ~(F.col("hets") / F.col("called") > max_het))
    return calls.join(t.select("taxon_id"), "taxon_id", "leftsemi")


def low_het_sites(calls: DataFrame, min_f: float, min_count: int, min_maf: float, max_maf: float) -> DataFrame:
    """F strictly over min_f; a monomorphic site has F = 1."""
    s = inbreeding(category_counts(calls)).where((F.col("f") > min_f) & (F.col("called") >= min_count) & F.col("maf").between(min_maf, max_maf))
    return calls.join(s.select("site_id"), "site_id", "leftsemi")


def hets_to_missing(calls: DataFrame) -> DataFrame:
    return calls.select("taxon_id", "site_id", *[F.when(is_het(), MISSING).otherwise(F.col(a)).cast("int").alias(a) for a in ("a1", "a2")])


def only_major_minor(calls: DataFrame) -> DataFrame:
    """A call with any other state becomes missing as a whole."""
    s = site_stats(calls).select("site_id", "major", "minor")
    fine = lambda a: F.coalesce(F.col(a) == F.col("major"), F.lit(False)) | F.coalesce(F.col(a) == F.col("minor"), F.lit(False))
    both = fine("a1") & fine("a2")
    return calls.join(s, "site_id").select("taxon_id", "site_id", *[F.when(both, F.col(a)).otherwise(MISSING).cast("int").alias(a) for a in ("a1", "a2")])


def polymorphic_sites(calls: DataFrame, max_missing: float, min_maf: float) -> DataFrame:
    s = site_stats(calls).where((1 - F.col("called") / F.col("taxa") <= max_missing) & (F.coalesce("maf", F.lit(0.0)) >= min_maf))
    return s.select("site_id")


def segregating_sites(calls: DataFrame, max_missing: float, ratio: float = 0.5) -> DataFrame:
    """Sites whose minor count fits the family's segregation: for ratio 0.25 or 0.75 a quarter must be likelier than a half and than
    error (0.002); else a half must be over twice as likely as both others together. The binomial coefficient cancels, so logs suffice."""
    s = site_stats(calls).where((F.col("minor_n") > 0) & (1 - F.col("called") / F.col("taxa") <= max_missing))
    at = lambda p: F.col("minor_n") * F.ln(F.lit(p)) + F.col("major_n") * F.ln(F.lit(1 - p))
    error, quarter, half = at(0.002), at(0.25), at(0.5)
    if ratio in (0.25, 0.75):
        return s.where((quarter > half) & (quarter > error)).select("site_id")
    return s.where(F.exp(error - half) + F.exp(quarter - half) < 0.5).select("site_id")


def random_subset(df: DataFrame, key: str, size: float, seed: int = 7) -> DataFrame:
    """size from 1 on is a number of keys, below it a share (one key at least); by the order of the keys' MD5, a sampling operator."""
    keys = df.select(key).distinct()
    n = int(size) if size >= 1 else max(1, int(keys.count() * size))
    ranked = row_numbers(keys, [F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), F.col(key)], "__nth")
    return df.join(ranked.where(F.col("__nth") <= n), key, "leftsemi")


def stepwise_subset(df: DataFrame, key: str, size: float) -> DataFrame:
    """Evenly spaced keys: places floor(k * step)."""
    keys = row_numbers(df.select(key).distinct(), [F.col(key)], "__i").withColumn("__i", F.col("__i") - 1)
    total = keys.count()
    n = min(total, int(size) if size >= 1 else max(1, int(total * size)))
    step = F.lit(total / max(1, n))
    at = F.ceil(F.col("__i") / step)
    return df.join(keys.where((F.floor(at * step) == F.col("__i")) & (at < n)).select(key), key, "leftsemi")


def by_annotation(df: DataFrame, name: str, value: str, column: str = "anno") -> DataFrame:
    """Rows whose annotation map (name to list of values) holds the value."""
    return df.where(F.array_contains(F.col(column)[name], value))
