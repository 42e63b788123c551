"""Sequencing reads to tags, counts by taxon and calls. All steps are SQL expressions; key files and enzymes are small lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import mismatches
from ..functions.stats import het_thresholds
from ..functions.tables import small

TAG = 64


def spelled(head, most: int, letters: str = "ACGTN"):
    """All texts that differ from head in at most so many places."""
    out, each = F.array(head), F.array(*map(F.lit, letters))

    def changed(h):
        at = lambda i: F.transform(each, lambda x: F.concat(F.substring(h, F.lit(1), i - 1), x, F.substring(h, i + 1, F.length(h))))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(h)), at))

    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, changed))))
    return out


def demultiplex(reads: DataFrame, keys: DataFrame, remnants: list[str], max_mismatch: int = 0) -> DataFrame:
    """reads (read_id, seq, or seq, n) with the taxon whose barcode and cut-site remnant begin it. keys: barcode, taxon. Fewer mismatches come first, then longer barcodes; a tie for the best gives none.

    The keys are spelled out with their mismatches, and reads meet them by equality of the beginning, one join for each length of barcode and
    remnant; reads aren't shuffled where the spelled keys are small.
    """
    k = keys.select("barcode", "taxon", F.explode(F.array(*map(F.lit, remnants))).alias("remnant")).withColumn("head", F.concat("barcode", "remnant"))
    v = k.withColumn("start", F.explode(spelled(F.col("head"), max_mismatch))).withColumn("miss", mismatches("start", "head"))
    hit = F.struct("miss", (-F.length("barcode")).alias("l"), "barcode", "taxon")
    v = v.groupBy(F.length("head").alias("n"), "start").agg(F.array_sort(F.collect_list(hit)).alias("b"))
    own = [c for c in ("read_id", "seq", "n") if c in reads.columns]
    out, found = reads.select(*own), []
    for n in sorted(r["n"] for r in k.select(F.length("head").alias("n")).distinct().collect()):  # a few lengths of barcodes
        heads = v.where(F.col("n") == n).select(F.col("start").alias(f"start_{n}"), F.col("b").alias(f"b_{n}"))
        out = out.join(small(heads, 200), F.substring("seq", 1, n) == F.col(f"start_{n}"), "left")
        found.append(F.coalesce(F.col(f"b_{n}"), F.array().cast(v.schema["b"].dataType)))
    if not found:
        return out.select(*own, F.lit(None).cast("string").alias("barcode"), F.lit(None).cast("string").alias("taxon")).where(F.lit(False))
    b = out.select(*own, F.array_sort(F.concat(*found)).alias("b")).where(F.size("b") > 0)
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    tie = F.coalesce((first["miss"] == second["miss"]) & (first["l"] == second["l"]) & (first["barcode"] != second["barcode"]), F.lit(False))
    return b.where(~tie).select(*own, first["barcode"].alias("barcode"), first["taxon"].alias("taxon"))


def counted(reads: DataFrame) -> DataFrame:
    """seq, n: each different read once, with how often it occurs, so that the steps to tags take it once; they keep n."""
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


def _occurrences(t: DataFrame):
    return F.sum("n") if "n" in t.columns else F.count(F.lit(1))


def tags(demuxed: DataFrame, cut_sites: list[str], length: int = TAG) -> DataFrame:
    """tag (padded with A), len and taxon (and n, if reads have it) of reads without N; cut after the second cut site."""
    insert = F.expr("substring(seq, length(barcode) + 1)")
    hits = [F.when(F.locate(s, insert, 2) > 0, F.locate(s, insert, 2) - 1 + len(s)) for s in cut_sites]
    end = F.least(F.lit(length), F.length(insert), *hits) if hits else F.least(F.lit(length), F.length(insert))
    t = demuxed.withColumn("len", end.cast("int")).withColumn("cut", F.substring(insert, F.lit(1), F.col("len")))
    return t.where(~F.col("cut").contains("N")).select("taxon", F.rpad("cut", length, "A").alias("tag"), "len", *[c for c in ("n",) if c in t.columns])


def tag_counts(t: DataFrame, min_count: int = 1) -> DataFrame:
    return t.groupBy("tag", "len").agg(_occurrences(t).alias("count")).where(F.col("count") >= min_count)


def tags_by_taxa(t: DataFrame, master: DataFrame | None = None) -> DataFrame:
    if master is not None:
        t = t.join(master.select("tag"), "tag", "leftsemi")
    return t.groupBy("tag", "taxon").agg(_occurrences(t).alias("count"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy(*[c for c in out.columns if c != "count"]).agg(F.sum("count").alias("count"))


def similar_tags(a: DataFrame, b: DataFrame, max_mismatch: int = 3, word: int = 16) -> DataFrame:
    """Pairs of tags that share a word at one of the fixed places and differ in at most max_mismatch bases; with three mismatches over four words none is missed."""
    w = lambda d, n: d.select(F.col("tag").alias(n)).select(n, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TAG // word - 1)), lambda i: F.substring(n, i * word + 1, F.lit(word)))).alias("at", "w"))
    p = w(a, "tag").join(w(b, "match"), ["at", "w"]).select("tag", "match").distinct()
    return p.withColumn("miss", mismatches("tag", "match")).where(F.col("miss") <= max_mismatch)


def best_matches(pairs: DataFrame) -> DataFrame:
    low = pairs.groupBy("tag").agg(F.min("miss").alias("miss"))
    return pairs.join(low, ["tag", "miss"])


def reciprocal_pairs(counts: DataFrame, pairs: DataFrame, error: float = 0.03) -> DataFrame:
    """Network filter: pairs whose smaller count can't be a sequencing error of the other, both having no other partner."""
    p = pairs.where("tag < match").join(counts.select("tag", F.col("count").alias("n1")), "tag").join(counts.select(F.col("tag").alias("match"), F.col("count").alias("n2")), "match")
    p = p.where(F.least("n1", "n2") > error * (F.col("n1") + F.col("n2")))
    both = p.select("tag", "match").union(p.select("match", "tag")).toDF("x", "y")
    one = both.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("x")
    return p.join(one.withColumnRenamed("x", "tag"), "tag", "leftsemi").join(one.withColumnRenamed("x", "match"), "match", "leftsemi")


def call_by_depth(depths: DataFrame, max_depth: int = 500) -> DataFrame:
    """depths: taxon_id, site_id, depth ARRAY<INT> by allele code. The two deepest alleles decide: heterozygous (deepest first) if the second reaches the binomial threshold of their sum; from max_depth on only if it ties."""
    t = F.array(*[F.lit(int(x)) for x in het_thresholds(max_depth)])
    top = F.array_sort(F.transform("depth", lambda d, i: F.struct((-d).alias("o"), i.alias("allele"))))
    d = depths.withColumn("top", top)
    n1, n2 = -F.col("top")[0]["o"], -F.col("top")[1]["o"]
    total = n1 + n2
    het = F.when(total >= max_depth, n1 == n2).otherwise((n2 > 0) & (n2 >= F.get(t, total)))
    one = F.col("top")[0]["allele"]
    return d.select("taxon_id", "site_id", F.when(n1 > 0, one).otherwise(15).alias("a1"), F.when(n1 <= 0, 15).when(het, F.col("top")[1]["allele"]).otherwise(one).alias("a2"))


def genotype_likelihoods(depths: DataFrame, error: float = 0.01) -> DataFrame:
    """depths: n1, n2. Phred-scaled likelihoods of the three calls (at most 255) and quality; depths count to 127."""
    a, b = F.least("n1", F.lit(127)), F.least("n2", F.lit(127))
    choose = F.aggregate(F.sequence(F.lit(0), b), F.lit(0.0), lambda s, i: s + F.when(i > 0, F.log10((a + i) / i)).otherwise(0.0))
    ls = [choose + a * np.log10(1 - error) + b * np.log10(error), choose + (a + b) * np.log10(0.5), choose + a * np.log10(error) + b * np.log10(1 - error)]
    d = depths.withColumns({f"l{i}": x for i, x in enumerate(ls)}).withColumn("top", F.greatest("l0", "l1", "l2"))
    pl = lambda i: F.least(F.lit(255), F.round(-10 * (F.col(f"l{i}") - F.col("top"))).cast("int")).alias(f"pl{i}")
    share = sum(F.pow(F.lit(10.0), F.col(f"l{i}") - F.col("top")) for i in range(3))
    out = d.select(*depths.columns, *[pl(i) for i in range(3)], F.floor(100 / share).cast("int").alias("gq"))
    return out.withColumn("call", F.when(F.col("pl1") <= F.least("pl0", "pl2"), 1).when(F.col("pl0") <= F.col("pl2"), 0).otherwise(2))


def site_acceptance(counts: DataFrame, min_f: float, min_maf: float, min_mac: int) -> DataFrame:
    """Rejects sites under two alleles, those whose share and count of the minor allele are both too low, and those with F under min_f."""
    return counts.where((F.col("minor_n") > 0) & ~((F.col("maf") < min_maf) & (F.col("minor_n") < min_mac)) & (F.col("f") >= min_f))


def nearby_loci(positions: DataFrame, border: int) -> DataFrame:
    from .windows import islands

    return islands(positions, "chrom", "pos", border)


def rank_tags(counts: DataFrame) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("len").orderBy(F.desc("count"), "tag")))
