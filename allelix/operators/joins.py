"""Joins and merges of calls, trait tables and name lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import MISSING, equal, is_missing
from .pairs import PAIRS_AT_ONCE, _runs, tiles_of


def common_taxa(*lists: DataFrame, key: str = "taxon_id") -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [x.select(key) for x in lists])


def all_taxa(*lists: DataFrame, key: str = "taxon_id") -> DataFrame:
    return reduce(lambda a, b: a.union(b), [x.select(key) for x in lists]).distinct()


def combine_traits(*tables: DataFrame, union: bool = True, key: str = "taxon_id") -> DataFrame:
    """Full or inner join on the taxon; a trait name that occurs again gets a number."""
    seen, out = {}, None
    for t in tables:
        names = []
        for n in t.columns:
            if n != key:
                seen[n] = seen.get(n, 0) + 1
                names.append(F.col(n).alias(n if seen[n] == 1 else f"{n}_{seen[n]}"))
        t = t.select(key, *names)
        out = t if out is None else out.join(t, key, "full" if union else "inner")
    return out


def combine_sites(*tables: DataFrame, union: bool = True) -> DataFrame:
    """Calls side by side over one taxa list; sites get their table's number as `part`. In a union, absent taxa have no rows, which means missing."""
    out = reduce(lambda a, b: a.unionByName(b), [t.withColumn("part", F.lit(i)) for i, t in enumerate(tables)])
    return out if union else out.join(common_taxa(*tables), "taxon_id", "leftsemi")


def merge_calls(*tables: DataFrame) -> DataFrame:
    """All taxa by all sites; of several calls the last table's non-missing one stays, so order matters. Cells without a call aren't stored."""
    every = reduce(lambda a, b: a.unionByName(b), [t.withColumn("__src", F.lit(i)) for i, t in enumerate(tables)])
    rank = F.struct((~is_missing()).cast("int"), "__src")
    best = every.groupBy("taxon_id", "site_id").agg(F.max_by(F.struct("a1", "a2"), rank).alias("c"))
    return best.select("taxon_id", "site_id", "c.a1", "c.a2")


def consensus(calls: DataFrame, names: DataFrame, share: float = 0.8) -> DataFrame:
    """Taxa of one name merge: homozygous for the major allele if its share of the gametes is over `share`, for the minor one if that share is, else heterozygous; missing without gametes. names: taxon_id, name."""
    g = calls.join(names, "taxon_id").select("name", "site_id", F.explode(F.array("a1", "a2")).alias("allele")).where("allele < 14")
    n = g.groupBy("name", "site_id", "allele").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.groupBy("name", "site_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "allele"))).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, e: a - e["o"])
    first = -F.col("x")[0]["o"] / total
    one, two = F.col("x")[0]["allele"], F.get("x", F.lit(1))["allele"]
    return ranked.select("name", "site_id", one.alias("a1"), F.when((first > share) | two.isNull(), one).otherwise(two).alias("a2"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per site: cells in both tables, comparable ones, mismatches, and both among homozygous calls only."""
    y = b.select("taxon_id", "site_id", F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    ok = ~is_missing() & ~is_missing("b1", "b2")
    hom = ok & (F.col("a1") == F.col("a2")) & (F.col("b1") == F.col("b2"))
    n = lambda x: F.sum(x.cast("long"))
    same = equal("a1", "a2", "b1", "b2")
    return a.join(y, ["taxon_id", "site_id"]).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("cells"), n(ok).alias("compared"), n(ok & ~same).alias("mismatches"), n(hom).alias("hom_compared"), n(hom & ~same).alias("hom_mismatches")
    )


def synonyms(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, score, known: the best known name for each name by letter pairs that they share; ties go to the smaller name.

    The score is pair_similarity. A task compares a tile of the names with a tile of the known ones and returns each name's best of that tile only:
    the n-th occurrences of letter pairs are columns of two matrices, whose product counts what two names share.
    """
    from ..functions.encoding import bigrams

    pairs_of = lambda df: df.select("taxon").distinct().select("taxon", bigrams("taxon").alias("g")).where(F.size("g") > 0)
    x, y = pairs_of(names), pairs_of(known)
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t, u = tiles_of(x.count(), parts), tiles_of(y.count(), parts)
    deal = lambda n: F.pmod(F.xxhash64("taxon"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = x.select("taxon", "g", F.lit(True).alias("target"), deal(t).alias("p"), upto(u).alias("q"))
    b = y.select("taxon", "g", F.lit(False).alias("target"), upto(t).alias("p"), deal(u).alias("q"))

    def nth(g) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        out = []
        for pair in g:
            seen[pair] = seen.get(pair, 0) + 1
            out.append((pair, seen[pair]))
        return out

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in _runs(batches, ["p", "q"]):
            a, b = g[g["target"]], g[~g["target"]].sort_values("taxon")
            if not len(a) or not len(b):
                continue
            of, wanted = {}, [nth(v) for v in b["g"]]
            has = [[of.setdefault(f, len(of)) for f in v] for v in wanted]
            m = np.zeros((len(b), len(of)), np.float32)
            for r, at in enumerate(has):
                m[r, at] = 1
            size, own = b["g"].map(len).to_numpy(), b["taxon"].to_numpy()
            step = max(1, PAIRS_AT_ONCE // len(b))
            for r in range(0, len(a), step):
                part = a.iloc[r : r + step]
                k = np.zeros((len(part), len(of)), np.float32)
                for i, v in enumerate(part["g"]):
                    k[i, [of[f] for f in nth(v) if f in of]] = 1
                score = 2.0 * (k @ m.T).astype(np.float64) / (part["g"].map(len).to_numpy()[:, None] + size)
                top = score.argmax(axis=1)  # the first of equal ones is the smaller name
                told = pd.DataFrame({"name": part["taxon"].to_numpy(), "score": score[np.arange(len(part)), top], "known": own[top]})
                yield told[told["score"] > 0]

    told = a.unionByName(b).repartition(t * u, "p", "q").sortWithinPartitions("p", "q").mapInPandas(best, "name string, score double, known string")
    g = told.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("less"), "known")).alias("x"))
    return g.select("name", (-F.col("x.less")).alias("score"), "x.known")


def convert_coordinates(positions: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: snp_id, old_chrom, old_pos, new_chrom, new_pos; used only where id and old place agree."""
    m = mapping.select("snp_id", F.col("old_chrom").alias("chrom"), F.col("old_pos").alias("pos"), "new_chrom", "new_pos")
    j = positions.join(m, ["snp_id", "chrom", "pos"], "left")
    return j.select("site_id", "snp_id", F.coalesce("new_chrom", "chrom").alias("chrom"), F.coalesce("new_pos", "pos").alias("pos"), F.col("new_pos").isNotNull().alias("converted"))


def nearest_site(points: DataFrame, positions: DataFrame) -> DataFrame:
    """As-of lookup: for each (chrom, pos) the last site at or before it, by one ordered pass over the union of both."""
    both = points.select("chrom", "pos", F.lit(None).cast("int").alias("site_id"), F.lit(1).alias("kind")).unionByName(positions.select("chrom", "pos", "site_id", F.lit(0).alias("kind")))
    w = Window.partitionBy("chrom").orderBy("pos", "kind", "site_id")
    return both.withColumn("site_before", F.last("site_id", ignorenulls=True).over(w)).where("kind = 1").select("chrom", "pos", "site_before")


def segments_to_sites(segments: DataFrame, positions: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """Range join of (taxon_id, chrom, start, end, donor1, donor2) to sites: segments are dealt to bins, so that the join is by equality."""
    s = segments.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    p = positions.withColumn("bin", F.floor(F.col("pos") / bin_size))
    return s.join(p, ["chrom", "bin"]).where(F.col("pos").between(F.col("start"), F.col("end"))).drop("bin")


def project(segments: DataFrame, positions: DataFrame, base: DataFrame) -> DataFrame:
    """Calls of the taxa from their two donors' calls: the first allele of each donor."""
    at = segments_to_sites(segments, positions).select("taxon_id", "site_id", "donor1", "donor2")
    d = lambda k, a: base.select(F.col("taxon_id").alias(f"donor{k}"), "site_id", F.col(a).alias(f"a{k}"))
    j = at.join(d(1, "a1"), ["donor1", "site_id"], "left").join(d(2, "a1"), ["donor2", "site_id"], "left")
    return j.select("taxon_id", "site_id", F.coalesce("a1", F.lit(MISSING)).alias("a1"), F.coalesce("a2", F.lit(MISSING)).alias("a2"))


def same_positions(a: DataFrame, b: DataFrame) -> bool:
    c = ["chrom", "pos", "snp_id"]
    return a.select(c).exceptAll(b.select(c)).isEmpty() and b.select(c).exceptAll(a.select(c)).isEmpty()
