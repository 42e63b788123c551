"""Variants at tag loci: tags that start at one place are aligned to the commonest of them, and columns with several bases are sites.

Every tag is aligned to its locus's commonest tag by itself, in batches of pairs, so a locus with many tags is no single task: an alignment is a row, and
columns, depths and calls are aggregates by locus and column. Batches run down the rows of all alignment matrices at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import materialize, small

#: Scores of the alignment within a locus: a match, a mismatch, a base that one of both lacks.
MATCH, MISMATCH, LACKS = 2, -2, -5
BASES = "ACGT"
GAP = 5
AT_ONCE = 512


def _codes(texts: list[str], fill: int) -> np.ndarray:
    """A row of letters a text, filled up to the longest."""
    wide = max(map(len, texts), default=0)
    out = np.full((len(texts), wide), fill, np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
    return out


def local_scores(a: list[str], b: list[str], match: int = 2, mismatch: int = 0, lacks: int = 1) -> np.ndarray:
    """The best score of a local alignment of each pair: match or mismatch a column, less `lacks` for each base that one of both lacks."""
    x, y = _codes(a, 0), _codes(b, 1)  # filled with codes that match nothing
    best, above = np.zeros(len(a), np.int64), np.zeros((len(a), y.shape[1] + 1), np.int64)
    slope = lacks * np.arange(y.shape[1] + 1)
    ends = np.array([len(t) for t in b], np.int64)
    inside = np.arange(1, y.shape[1] + 1)[None] <= ends[:, None]
    for r in range(x.shape[1]):
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(x[:, r, None] == y, match, mismatch), above[:, 1:] - lacks)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope, axis=1) - slope, 0)  # a base lacking after another
        live = x[:, r] != 0
        if y.shape[1]:
            best = np.where(live, np.maximum(best, np.where(inside, row[:, 1:], 0).max(axis=1)), best)
        above = row
    return best


def local_alignment(pairs: DataFrame, a: str, b: str, **scores: int) -> DataFrame:
    """pairs with score, the best local alignment of two columns of sequences; null if either is."""

    @F.pandas_udf("long")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        order = np.argsort(y.str.len().to_numpy(), kind="stable")  # batches of like lengths
        for i in range(0, len(x), AT_ONCE):
            at = order[i : i + AT_ONCE]
            out[at] = local_scores([x.iloc[k] for k in at], [y.iloc[k] for k in at], **scores)
        return pd.Series(out)

    told = pairs.withColumn("score", score(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return told.withColumn("score", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col("score")))


def _aligned(tags: list[str], centres: list[str]) -> list[list[tuple[int, int, str]]]:
    """For each pair (column of the centre, 0 or the number of an inserted base after it, base or '-'); both begin together, ends are free."""
    x, y = _codes(tags, 0), _codes(centres, 1)
    n, m = np.array([len(t) for t in tags]), np.array([len(t) for t in centres])
    rows, cols = x.shape[1] + 1, y.shape[1] + 1
    h = np.zeros((rows, len(tags), cols), np.int32)
    slope = LACKS * np.arange(cols)
    h[0] = slope
    for r in range(1, rows):
        row = np.empty((len(tags), cols), np.int32)
        row[:, 0] = LACKS * r
        row[:, 1:] = np.maximum(h[r - 1, :, :-1] + np.where(x[:, r - 1, None] == y, MATCH, MISMATCH), h[r - 1, :, 1:] + LACKS)
        h[r] = np.maximum.accumulate(row - slope, axis=1) + slope
    out = []
    for i, (tag, centre) in enumerate(zip(tags, centres, strict=True)):
        # The last row or column, wherever the score is best: what is left of the other sequence lies beyond the end.
        last_row, last_col = h[n[i], i, : m[i] + 1], h[: n[i] + 1, i, m[i]]
        r, c = (n[i], int(last_row.argmax())) if last_row.max() >= last_col.max() else (int(last_col.argmax()), m[i])
        steps = []
        while r > 0 or c > 0:
            v = h[r, i, c]
            if r and c and v == h[r - 1, i, c - 1] + (MATCH if tag[r - 1] == centre[c - 1] else MISMATCH):
                r, c = r - 1, c - 1
                steps.append((c, 0, tag[r]))
            elif c and v == h[r, i, c - 1] + LACKS:
                c -= 1
                steps.append((c, 0, "-"))
            else:
                r -= 1
                steps.append((c - 1, 1, tag[r]))
        told, k = [], 0
        for c, inserted, base in reversed(steps):
            k = k + 1 if inserted else 0
            told.append((c, k, base))
        out.append(told)
    return out


def tag_loci(tag_map: DataFrame, counts: DataFrame, min_taxa: int = 1) -> DataFrame:
    """chrom, strand, pos, tag, centre: tags of places with two tags or more and reads in at least min_taxa taxa; centre is the commonest tag.

    tag_map: tag, chrom, strand, pos. counts: tag, taxon, count. Ties go to the smaller tag.
    """
    place = ["chrom", "strand", "pos"]
    m = tag_map.select("tag", *place).where("chrom IS NOT NULL AND pos IS NOT NULL AND strand IS NOT NULL")
    c = counts.where("count > 0")
    total = c.groupBy("tag").agg(F.sum("count").alias("n"), F.count("taxon").alias("known")).join(m, "tag")  # a row a tag from here on
    total = materialize(total.groupBy(*place, "tag").agg(F.sum("n").alias("n"), F.sum("known").alias("known")), "locus-tags")
    centre = total.groupBy(*place).agg(F.count(F.lit(1)).alias("tags"), F.min(F.struct((-F.col("n")).alias("less"), "tag")).alias("first"), F.sum("known").alias("known")).where("tags > 1")
    if min_taxa <= 1:
        kept = centre.where(F.col("known") >= min_taxa)
    else:
        own = small(total.select("tag", *place), 100)
        taxa = c.where("taxon IS NOT NULL").join(own, "tag").select(*place, "taxon").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("taxa"))
        kept = centre.join(taxa.where(F.col("taxa") >= min_taxa), place)
    return total.select(*place, "tag").join(kept.select(*place, F.col("first.tag").alias("centre")), place)


def aligned_bases(loci: DataFrame) -> DataFrame:
    """chrom, strand, pos, tag, col, ins, base: a row a base of each tag's alignment with its centre; ins numbers bases that follow column col and are inserted; '-' is a base that the tag lacks."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[list[tuple[int, int, str]]] = []
            for i in range(0, len(b), AT_ONCE):
                found += _aligned(list(b["tag"].iloc[i : i + AT_ONCE]), list(b["centre"].iloc[i : i + AT_ONCE]))
            b = b.drop(columns="centre").assign(bases=[[{"col": c, "ins": k, "base": x} for c, k, x in f] for f in found])
            yield b

    fields = {f.name: f.dataType.simpleString() for f in loci.schema.fields}
    schema = ", ".join(f"{n} {fields[n]}" for n in ("chrom", "strand", "pos", "tag")) + ", bases array<struct<col:int,ins:int,base:string>>"
    return loci.select("chrom", "strand", "pos", "tag", "centre").mapInPandas(align, schema).select("chrom", "strand", "pos", "tag", F.explode("bases").alias("x")).select("chrom", "strand", "pos", "tag", "x.*")


def locus_sites(bases: DataFrame, with_gaps: bool = False) -> DataFrame:
    """chrom, strand, pos, tag, col, ins, base: bases of the columns that differ between tags, ready to be counted.

    A tag without a base in an inserted column that lies within it lacks it. A site needs two bases of A, C, G and T, or, with
    with_gaps, one and a lacking one. Other letters count for nothing.
    """
    place = ["chrom", "strand", "pos"]
    known = bases.where(F.col("base").isin(*BASES, "-"))
    inserted = known.where("ins > 0").select(*place, "col", "ins").distinct()
    ends = bases.where("ins = 0").groupBy(*place, "tag").agg(F.max("col").alias("end"))
    over = ends.join(inserted, place).where("end > col").join(known.where("ins > 0").select(*place, "tag", "col", "ins"), [*place, "tag", "col", "ins"], "leftanti")
    every = known.union(over.select(*place, "tag", "col", "ins", F.lit("-").alias("base")))
    kinds = every.groupBy(*place, "col", "ins").agg(F.count_distinct(F.when(F.col("base") != "-", F.col("base"))).alias("bases"), F.max((F.col("base") == "-").cast("int")).alias("gap"))
    need = F.col("bases") >= 2 if not with_gaps else F.col("bases") + F.col("gap") >= 2
    return every.join(kinds.where(need).select(*place, "col", "ins"), [*place, "col", "ins"])


def site_depths(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """chrom, strand, pos, site_pos, ins, taxon, depth: reads of A, C, G, T, (nothing) and a lacking base, as an array by allele code, on the plus strand."""
    minus = F.col("strand") == -1
    code = F.when(F.col("base") == "-", F.lit(GAP)).otherwise(F.instr(F.when(minus, F.lit("TGCA")).otherwise(F.lit(BASES)), F.col("base")) - 1)
    at = F.when(minus, F.col("pos") - F.col("col")).otherwise(F.col("pos") + F.col("col"))
    key = ["chrom", "strand", "pos", "site_pos", "ins"]
    s = sites.select("chrom", "strand", "pos", at.alias("site_pos"), "ins", "tag", code.alias("code"))
    s = materialize(s.groupBy("tag").agg(F.collect_list(F.struct(*key, "code")).alias("at")), "tag-sites")
    size = s.agg(F.count(F.lit(1)), F.coalesce(F.sum(100 + 40 * F.size("at")), F.lit(0))).first()
    # Counts are dealt by taxon once; the sites of a few tags are broadcast, so that neither the join nor the sums deal the bases.
    c = counts.where("count > 0").repartition("taxon").join(small(s, -(-size[1] // max(1, size[0])), size[0]), "tag")
    g = c.select(F.explode("at").alias("x"), "taxon", "count").select("x.*", "taxon", "count").groupBy(*key, "taxon")
    return g.agg(F.array(*[F.sum(F.when(F.col("code") == i, F.col("count")).otherwise(0)).cast("int") for i in range(6)]).alias("depth"))


def discover(tag_map: DataFrame, counts: DataFrame, min_taxa: int = 1, min_maf: float = 0.01, min_mac: int = 10, with_gaps: bool = False) -> DataFrame:
    """chrom, strand, pos, site_pos, ins, major, minor, maf, mac, taxon, a1, a2: calls of the sites that are accepted.

    Calls are made from depths by the binomial thresholds. A site is rejected if it has one allele, or if both the share and the count of its
    second allele are too low.
    """
    from .reads import call_by_depth

    key = ["chrom", "strand", "pos", "site_pos", "ins"]
    d = site_depths(locus_sites(aligned_bases(tag_loci(tag_map, counts, min_taxa)), with_gaps), counts)
    c = call_by_depth(d.select(F.struct(*key).alias("site_id"), F.col("taxon").alias("taxon_id"), "depth")).select("site_id.*", F.col("taxon_id").alias("taxon"), "a1", "a2")
    c = materialize(c, "locus-calls")  # read for the alleles and for the result
    n = c.where("a1 < 14").select(*key, F.explode(F.array("a1", "a2")).alias("allele")).groupBy(*key, "allele").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*key).orderBy(F.desc("n"), "allele")
    r = n.withColumns({"rank": F.row_number().over(order), "total": F.sum("n").over(Window.partitionBy(*key))})
    s = r.groupBy(*key).agg(F.max(F.when(F.col("rank") == 1, F.col("allele"))).alias("major"), F.max(F.when(F.col("rank") == 2, F.col("allele"))).alias("minor"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("mac"), F.max("total").alias("total"))
    s = s.where("minor IS NOT NULL").withColumn("maf", F.col("mac") / F.col("total")).where((F.col("maf") >= min_maf) | (F.col("mac") >= min_mac))
    return c.join(small(s.drop("total"), 60), key)
