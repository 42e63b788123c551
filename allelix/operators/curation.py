"""Site curation by linkage, double crossovers and duplicates; depth codes, alignment strings and coverage of tag loci."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import MISSING, is_het, is_missing
from .filters import low_het_sites
from .summary import site_stats, taxa_stats

#: Fixed values of the one-byte depth code: exact to 182, then logarithms of this base over an offset.
DEPTH_BASE, DEPTH_EXACT, DEPTH_OFFSET = 1.0746, 182, 126


def sites_by_ld(calls: DataFrame, positions: DataFrame, ld: DataFrame, min_r2: float, min_distance: int = 0, max_p: float | None = None, keep_unproven: bool = False) -> DataFrame:
    """Sites with an r2 of at least min_r2 to a site at least min_distance away (other chromosomes count as far).

    ld: site_i, site_j, r2 and, with max_p, p; then the least p times the number of such pairs must be at most max_p too.
    keep_unproven keeps sites without any such pair.
    """
    at = lambda k: positions.select(F.col("site_id").alias(f"site_{k}"), F.col("chrom").alias(f"chrom_{k}"), F.col("pos").alias(f"pos_{k}"))
    far = (F.col("chrom_i") != F.col("chrom_j")) | (F.abs(F.col("pos_i") - F.col("pos_j")) >= min_distance)
    pairs = ld.where("r2 is not null").join(at("i"), "site_i").join(at("j"), "site_j").where(far)
    p = F.col("p") if max_p is not None else F.lit(0.0)
    s = pairs.select(F.explode(F.array("site_i", "site_j")).alias("site_id"), "r2", p.alias("p")).groupBy("site_id").agg(F.max("r2").alias("r2"), (F.min("p") * F.count(F.lit(1))).alias("p"))
    good = s.where((F.col("r2") >= min_r2) & (F.col("p") <= (0.0 if max_p is None else max_p))).select("site_id")
    if keep_unproven:
        good = good.union(calls.select("site_id").distinct().join(s, "site_id", "leftanti"))
    return calls.join(good, "site_id", "leftsemi")


def low_double_crossover(calls: DataFrame, by: str = "site_id", max_rate: float = 0.1, min_count: int = 1) -> DataFrame:
    """Drops sites (or taxa) whose homozygous calls with a homozygous call on either side differ from equal neighbours too often: sites need a rate under max_rate, taxa one of at most max_rate, and min_count such calls."""
    w = Window.partitionBy("taxon_id").orderBy("site_id")
    c = calls.where(~is_missing() & ~is_het()).withColumns({"p": F.lag("a1").over(w), "n": F.lead("a1").over(w)}).where("p is not null and n is not null")
    rate = F.avg(((F.col("p") == F.col("n")) & (F.col("a1") != F.col("p"))).cast("double"))
    g = c.groupBy(by).agg(rate.alias("rate"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_count)
    fine = F.col("rate") < max_rate if by == "site_id" else F.col("rate") <= max_rate
    return calls.join(g.where(fine).select(by), by, "leftsemi")


def called_snp_filters(calls: DataFrame, taxon_share: float = 0.1, site_count: int = 1, min_f: float = -2.0, min_maf: float = 0.0, max_maf: float = 1.0) -> DataFrame:
    """Taxa with enough calls first, then sites by count, F and minor share over the taxa that stay."""
    t = taxa_stats(calls).where(F.col("called") / F.col("sites") >= taxon_share).select("taxon_id")
    return low_het_sites(calls.join(t, "taxon_id", "leftsemi"), min_f, site_count, min_maf, max_maf)


def same_tag_sites(positions: DataFrame, ld: DataFrame, min_r2: float, span: int = 64) -> DataFrame:
    """site_id of the sites that stay when each site leads those that follow it within span on its chromosome, up to the first one whose r2 with it is missing or under min_r2, which leads on.

    The walk goes from leader to leader, so sites are grouped where a gap of span or more ends every walk.
    """
    order = Window.partitionBy("chrom").orderBy("pos", "site_id")
    gap = (F.col("pos") - F.lag("pos").over(order) >= span) | F.lag("pos").over(order).isNull()
    s = positions.select("site_id", "chrom", "pos").withColumn("island", F.sum(gap.cast("int")).over(order))
    high = ld.where(F.col("r2") >= min_r2).select(F.least("site_i", "site_j").alias("site_id"), F.greatest("site_i", "site_j").alias("other"))
    high = high.unionByName(high.select(F.col("other").alias("site_id"), F.col("site_id").alias("other")))
    near = positions.select(F.col("site_id").alias("other"), F.col("chrom").alias("c2"), F.col("pos").alias("p2"))
    tied = high.join(s.select("site_id", "chrom", "pos"), "site_id").join(near, "other").where((F.col("chrom") == F.col("c2")) & (F.col("p2") - F.col("pos")).between(0, span - 1))
    s = s.join(tied.groupBy("site_id").agg(F.collect_set("other").alias("tied")), "site_id", "left")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        kept, lead, tied, at = [], None, set(), 0
        for site, pos, others in g.sort_values(["pos", "site_id"])[["site_id", "pos", "tied"]].itertuples(index=False):
            if lead is None or pos - at >= span or site not in tied:
                kept.append(site)
                lead, tied, at = site, set(others) if others is not None else set(), pos
        return pd.DataFrame({"site_id": kept})

    return s.groupBy("chrom", "island").applyInPandas(walk, "site_id int")


def merge_duplicate_sites(calls: DataFrame, positions: DataFrame, max_mismatch: float = 0.05, call_hets: bool = True) -> DataFrame:
    """Sites of one place and one unordered pair of alleles merge, in the order of their ids, into the first one that differs from them in at most max_mismatch of the calls that both have.

    Missing calls are filled; calls that differ become heterozygous, or missing unless call_hets. Gaps (code 5) don't merge.
    Only places with several sites are grouped; a group is the calls of one place.
    """
    placed = calls.join(positions.select("site_id", "chrom", "pos"), "site_id")
    many = positions.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chrom", "pos")
    s = site_stats(calls).select("site_id", F.least("major", "minor").alias("lo"), F.greatest("major", "minor").alias("hi"))
    shape = "site_id int, taxon_id int, a1 int, a2 int"

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        todo = [(i, tuple(x.iloc[0][["lo", "hi"]]), x.set_index("taxon_id")[["a1", "a2"]]) for i, x in g.groupby("site_id")]
        out = []
        while todo:
            (site, alleles, own), rest = todo[0], []
            for other in todo[1:]:
                if 5 in alleles or alleles != other[1]:
                    rest.append(other)
                    continue
                a, b = own.align(other[2], fill_value=MISSING)
                has = ~((a["a1"] == MISSING) & (a["a2"] == MISSING)), ~((b["a1"] == MISSING) & (b["a2"] == MISSING))
                both = has[0] & has[1]
                differ = both & ((a.min(axis=1) != b.min(axis=1)) | (a.max(axis=1) != b.max(axis=1)))
                if both.any() and differ.sum() / both.sum() > max_mismatch:
                    rest.append(other)
                    continue
                own = a.where(has[0], b, axis=0)
                own.loc[differ] = list(alleles) if call_hets else MISSING
            out.append(own.reset_index().assign(site_id=site))
            todo = rest
        return pd.concat(out)[["site_id", "taxon_id", "a1", "a2"]].astype("int32")

    merged = placed.join(many, ["chrom", "pos"], "leftsemi").join(s, "site_id").fillna(-1, ["lo", "hi"]).groupBy("chrom", "pos").applyInPandas(merge, shape)
    alone = placed.join(many, ["chrom", "pos"], "leftanti")
    return alone.select("site_id", "taxon_id", "a1", "a2").unionByName(merged)


def encoded_depth(depth: str | Column) -> Column:
    """A depth as a signed byte: itself to 127, then downwards from 0 to the last exact one, then by its logarithm."""
    d = F.col(depth) if isinstance(depth, str) else depth
    log = F.greatest(F.lit(-128), (-F.ln(d - DEPTH_OFFSET) / F.ln(F.lit(DEPTH_BASE))).cast("int"))
    return F.when(d <= 127, d).when(d <= DEPTH_EXACT, 127 - d).otherwise(log).cast("int")


def decoded_depth(code: str | Column) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c >= 0, c).when(c >= 127 - DEPTH_EXACT, 127 - c).otherwise(DEPTH_OFFSET + F.pow(F.lit(DEPTH_BASE), F.lit(0.5) - c)).cast("int")


def aligned_ends(cigar: str = "cigar", pos: str = "pos") -> tuple[Column, Column]:
    """(start, end) on the reference: soft clips count as aligned, a first one before pos, others after; insertions and other operations don't count."""
    n = F.transform(F.regexp_extract_all(F.col(cigar), F.lit(r"(\d+)[A-Za-z]")), lambda x: x.cast("int"))
    op = F.upper(F.array_join(F.regexp_extract_all(F.col(cigar), F.lit(r"\d+([A-Za-z])")), ""))
    clip = F.when(F.startswith(op, F.lit("S")), F.get(n, F.lit(0))).otherwise(0)
    span = F.aggregate(F.transform(n, lambda x, i: F.when(F.substring(op, i + 1, F.lit(1)).isin("M", "D", "S"), x).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return F.col(pos) - clip, F.col(pos) - clip + span - 1


def reads_per_sample(demuxed: DataFrame) -> DataFrame:
    """Reads and distinct sequences of each taxon."""
    one = demuxed.groupBy("taxon", "seq").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("taxon").agg(F.sum("n").alias("reads"), F.count(F.lit(1)).alias("sequences"))


def locus_cover(counts: DataFrame) -> DataFrame:
    """counts: locus, tag, taxon, count. Taxa with a read at the locus, tags and reads of it."""
    c = counts.where("count > 0").groupBy("locus", "taxon").agg(F.sum("count").alias("n"), F.collect_set("tag").alias("tags"))
    t = c.select("locus", F.explode("tags").alias("tag")).distinct().groupBy("locus").agg(F.count(F.lit(1)).alias("tags"))
    return c.groupBy("locus").agg(F.count(F.lit(1)).alias("taxa"), F.sum("n").alias("reads")).join(t, "locus")


def marker_consistency(markers: DataFrame) -> DataFrame:
    """markers: name, label. One row: whether all labels are numbers or none is, and whether all have as many alleles (split at ':'); true for no markers."""
    number = F.col("label").rlike(r"^[-+]?\d+(\.\d+)?$")
    same = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    return markers.agg(same(number).alias("same_kind"), same(F.when(~number, F.size(F.split("label", ":")))).alias("same_ploidy"))


def missing_counts(values: DataFrame, columns: list[str]) -> DataFrame:
    """name, missing and present of each column over the rows; one row more (null name) for rows with anything missing."""
    lacks = {c: F.col(c).isNull() | (F.isnan(c) if dict(values.dtypes)[c] in ("double", "float") else F.lit(False)) for c in columns}
    any_ = F.lit(False)
    for x in lacks.values():
        any_ = any_ | x
    one = values.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(f"m_{i}") for i, x in enumerate([*lacks.values(), any_])])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m_{i}").alias("missing")) for i, c in enumerate([*columns, None])])
    return one.select("n", F.explode(rows).alias("r")).select("r.name", "r.missing", (F.col("n") - F.col("r.missing")).alias("present"))
