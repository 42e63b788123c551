"""Sites by place, orders of sites, taxa and results, depths, and tables by chromosome. Lists are DataFrames, joined and never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import row_numbers, small
from .quality import neighbor_correlation
from .summary import site_stats


def sites_at_positions(calls: DataFrame, positions: DataFrame, listed: DataFrame, keep: bool = True) -> DataFrame:
    """Calls at the listed (chrom, pos); with keep False at all others."""
    at = positions.join(listed.select("chrom", "pos").distinct(), ["chrom", "pos"], "leftsemi").select("site_id")
    return calls.join(at, "site_id", "leftsemi" if keep else "leftanti")


def sites_by_index(calls: DataFrame, positions: DataFrame, indexes: DataFrame) -> DataFrame:
    """Calls at the sites whose place (from 0) in order of chromosome and position is listed as `index`."""
    ranked = row_numbers(positions, [F.col("chrom"), F.col("pos"), F.col("site_id")], "place")
    return calls.join(ranked.join(indexes, F.col("place") - 1 == F.col("index"), "leftsemi").select("site_id"), "site_id", "leftsemi")


def sites_by_neighbor_ld(calls: DataFrame, window: int, least: float, start: int = 10) -> DataFrame:
    """Sites whose mean absolute correlation with their neighbours is at least `least`."""
    good = neighbor_correlation(calls, window, start).where(F.col("mean_r") >= least)
    return calls.join(good.select("site_id"), "site_id", "leftsemi")


def traits_by_kind(values: DataFrame, kinds: DataFrame, wanted: list[str]) -> DataFrame:
    """Values (taxon_id, trait, value) of the traits whose kind (data, covariate, factor, marker, exclude) is wanted."""
    return values.join(kinds.where(F.col("kind").isin(wanted)).select("trait"), "trait", "leftsemi")


def rename_taxa(table: DataFrame, synonyms: DataFrame, column: str = "taxon") -> DataFrame:
    """Names that synonyms (name, accepted) lists become the accepted ones, others stay."""
    s = synonyms.select(F.col("name").alias(column), "accepted")
    return table.join(s, column, "left").withColumn(column, F.coalesce("accepted", column)).drop("accepted").select(*table.columns)


def write_by_chromosome(calls: DataFrame, positions: DataFrame, path: str) -> None:
    """A folder of calls for each chromosome."""
    calls.join(positions.select("site_id", "chrom"), "site_id").repartition("chrom", "site_id").write.partitionBy("chrom").parquet(path)


def join_on_id(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All ids of both; columns of the right one whose names clash get the suffix _2."""
    new = {c: f"{c}_2" if c in left.columns else c for c in right.columns if c != key}
    return left.join(right.select(key, *[F.col(a).alias(b) for a, b in new.items()]), key, "full")


def distances_without(dist: DataFrame, taxa: DataFrame) -> DataFrame:
    """Pairs of (taxon_i, taxon_j) in which no listed taxon occurs."""
    gone = small(taxa.select("taxon_id").distinct(), 16)
    for c in ("taxon_i", "taxon_j"):
        dist = dist.join(gone.withColumnRenamed("taxon_id", c), c, "leftanti")
    return dist.select("taxon_i", "taxon_j", "dist")


def percentile_steps(df: DataFrame, columns: list[str], steps: int = 20) -> DataFrame:
    """(name, step, value): each column sorted by itself, its values at places floor(step * n / steps), and the last."""
    out = None
    for name in columns:
        v = df.select(F.col(name).cast("double").alias("value")).where("value is not null")
        n = v.count()
        at = df.sparkSession.createDataFrame([(k, min(n - 1, k * n // steps) + 1) for k in range(steps + 1) if n], "step int, place long")
        one = row_numbers(v, [F.col("value")], "place").join(F.broadcast(at), "place").select(F.lit(name).alias("name"), "step", "value")
        out = one if out is None else out.unionByName(one)
    return out


def depth_by(depths: DataFrame, key: str) -> DataFrame:
    """Reads and covered cells by taxon_id or site_id. depths: taxon_id, site_id, depth ARRAY<INT>."""
    total = F.aggregate("depth", F.lit(0).cast("long"), lambda a, x: a + x)
    return depths.groupBy(key).agg(F.sum(total).alias("reads"), F.count_if(total > 0).alias("covered"))


def taxa_groups(taxa: DataFrame, name: str, column: str = "anno") -> DataFrame:
    """(value, taxa) for each value of an annotation; a taxon with several values is in several groups."""
    return taxa.select(F.explode(F.col(column)[name]).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("taxa"))


def state_counts(calls: DataFrame) -> DataFrame:
    """Distinct states that aren't missing, by site, and whether every taxon has one of its own."""
    s = calls.where("not (a1 = 15 and a2 = 15)").groupBy("site_id").agg(F.count_distinct(F.least("a1", "a2") * 16 + F.greatest("a1", "a2")).alias("states"), F.count(F.lit(1)).alias("called"))
    return s.select("site_id", "states", (F.col("states") == F.col("called")).alias("unique"))


def polymorphic_windows(calls: DataFrame, positions: DataFrame, window: int, step: int) -> DataFrame:
    """Windows of `window` polymorphic sites of a chromosome, in order of position: first and last position and mean minor frequency."""
    s = site_stats(calls).where("minor_n > 0").select("site_id", "maf").join(positions, "site_id")
    at = Window.partitionBy("chrom").orderBy("pos", "site_id")
    s = s.withColumns({"i": F.row_number().over(at) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("chrom"))})
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (window - 1)) / step)).cast("int")
    s = s.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("i") / step).cast("int")))).where(F.col("w") * step + window <= F.col("n"))
    return s.groupBy("chrom", (F.col("w") * step).alias("start")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.avg("maf").alias("mean_maf"))


def misplaced(positions: DataFrame) -> DataFrame:
    """Sites that stand before their predecessor on the chromosome."""
    return positions.withColumn("before", F.lag("pos").over(Window.partitionBy("chrom").orderBy("site_id"))).where("pos < before").select("site_id", "chrom", "pos", "before")


def natural_key(name: str) -> Column:
    """Sort key of names in which runs of digits compare as numbers (of up to 20 digits)."""
    part = lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(F.col(name), F.lit(r"(\d+|\D+)"), F.lit(1)), part), "")


def in_order(df: DataFrame, name: str, natural: bool = False) -> DataFrame:
    """df with the place (from 1) of its names, by code point or with digits as numbers."""
    return row_numbers(df, [natural_key(name) if natural else F.col(name)], "place")


def ranked_ld(ld: DataFrame) -> DataFrame:
    """Pairs with their place by falling r2."""
    return row_numbers(ld.where("r2 is not null"), [F.col("r2").desc(), F.col("site_i"), F.col("site_j")], "place")


def association_by_sums(calls: DataFrame, values: DataFrame) -> DataFrame:
    """F and r2 of the call classes over the mean alone, per trait and site: counts, sums and squares by class, one partial aggregate.

    values: taxon_id, trait, value. Values are centred by trait first, which keeps the sums of squares exact enough.
    """
    v = values.where("value is not null")
    v = v.join(v.groupBy("trait").agg(F.avg("value").alias("mean")), "trait").select("taxon_id", "trait", (F.col("value") - F.col("mean")).alias("y"))
    c = calls.where("a1 < 14 and a2 < 14").select("taxon_id", "site_id", (F.least("a1", "a2") * 16 + F.greatest("a1", "a2")).alias("call"))
    g = c.join(v, "taxon_id").groupBy("trait", "site_id", "call").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    t = g.groupBy("trait", "site_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m"))
    total, model = F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("m") - F.col("s") * F.col("s") / F.col("n")
    df, error = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.when((df > 0) & (error > 0) & (total - model > 1e-9), model / df / ((total - model) / error))
    return t.select("trait", "site_id", "n", df.alias("df"), error.alias("error_df"), f.alias("f"), F.when(total > 0, model / total).alias("r2"))
