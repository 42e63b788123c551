"""Pairwise operators. Calls become 64-bit words of allele presence.

All pairs of taxa are compared by tiles: taxa are dealt to tiles of bounded size, each packed and written once; a task takes a pair of tiles, chunk of sites by
chunk, and sums their pairs as matrices. Tasks read the tiles of others, so neither pairs nor copies of tiles are shuffled, and scratch grows as the input does.
Neighbouring sites are joined on their block and bin; sums over blocks are partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import presence_bits
from ..functions.tables import materialize, row_numbers, small
from .summary import site_stats


#: Taxa a tile has at most (about), least taxa of a tile where more tiles serve only to spread the work, and pairs of one batch of the result.
TILE_TAXA, LEAST_TAXA, PAIRS_AT_ONCE = 2048, 64, 1 << 17
#: Rows (of an item and chunk) that a tile has at most (about), as a task holds a whole tile.
TILE_ROWS = 1 << 14
#: Words, sites or traits of a chunk. A task holds two tiles of this width, and sums over the chunks.
WORDS_AT_ONCE, SITES_AT_ONCE = 256, 4096


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each run of equal keys; rows come sorted by keys, and a run may lie in several batches."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(k)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            here = tuple(k[start])
            if held and here != key:
                yield key, pd.concat(held)
                held = []
            key = here
            held.append(batch.iloc[start:end])
    if held:
        yield key, pd.concat(held)


class _Sums:
    """Sums of matrices over chunks for two tiles of items; items may come with a later chunk."""

    def __init__(self, item: str, names: list[str], same_tile: bool, diagonal: bool):
        self.item, self.names, self.same_tile, self.diagonal = item, names, same_tile, diagonal
        self.x, self.y, self.met, self.found = {}, {}, np.zeros((0, 0), bool), {}

    def add(self, a: pd.DataFrame, b: pd.DataFrame, found: dict[str, np.ndarray]) -> None:
        places = []
        for of, g in ((self.x, a), (self.y, b)):
            places.append(np.array([of.setdefault(v, len(of)) for v in g[self.item].tolist()]))
        if not self.found and len(self.x) == len(a) and len(self.y) == len(b):
            self.met, self.found = np.ones((len(a), len(b)), bool), {k: found[k] for k in self.names}
            return
        at = np.ix_(*places)
        more = ((0, len(self.x) - self.met.shape[0]), (0, len(self.y) - self.met.shape[1]))
        self.met = np.pad(self.met, more)
        self.met[at] = True
        for k in self.names:
            self.found[k] = np.pad(self.found[k], more) if k in self.found else np.zeros(self.met.shape, found[k].dtype)
            self.found[k][at] += found[k]

    def told(self) -> Iterator[pd.DataFrame]:
        """Pairs that met in a chunk, the smaller item first."""
        x, y = np.array(list(self.x)), np.array(list(self.y))
        step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
        for r in range(0, len(x), step):
            at = self.met[r : r + step]
            if self.same_tile:
                at = at & ((x[r : r + step, None] <= y) if self.diagonal else (x[r : r + step, None] < y))
            i, j = (v[at] for v in np.broadcast_arrays(x[r : r + step, None], y))
            yield pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j)} | {k: self.found[k][r : r + step][at] for k in self.names})


def tiles_of(items: int, parts: int) -> int:
    """Enough tiles for parts tasks, with a bounded number of items in each."""
    return max(1, min(math.ceil(math.sqrt(8 * parts)), math.ceil(items / LEAST_TAXA)), math.ceil(items / TILE_TAXA))


def _stored(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _read(stored: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(stored).read_pandas()


def tiled_pairs(rows: DataFrame, item: str, kernel: Callable[..., dict[str, np.ndarray]], columns: str, diagonal: bool = False, shared: DataFrame | None = None, tiles: int | None = None) -> DataFrame:
    """i < j (or <= with diagonal) and the columns that kernel gives, summed over chunks: one row a pair that shares a chunk. Pairs aren't shuffled, and each tile once only.

    rows: item, chunk and what kernel reads, one row an item and chunk; shared: one row a chunk, of the same columns but the item.
    kernel takes the rows of two tiles in a chunk, and the chunk's shared row, and gives matrices of (row, row).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows, "pairs")
    items, count = rows.agg(F.count_distinct(item), F.count(F.lit(1))).first()
    n = tiles or max(tiles_of(items, parts), math.ceil(count / TILE_ROWS))
    names, has_shared = [c.split()[0] for c in columns.split(", ")], shared is not None

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (own, chunk), g in _runs(batches, ["own", "chunk"]):
            yield pd.DataFrame({"own": [own], "chunk": [chunk], "rows": [_stored(g.drop(columns=["own", "chunk"]))]})

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk": b["chunk"], "shared": [_stored(b.iloc[[r]].drop(columns="chunk")) for r in range(len(b))]})

    own = rows.withColumn("own", F.pmod(F.xxhash64(item), F.lit(n)).cast("int")).withColumn("chunk", F.col("chunk").cast("long"))
    packed = materialize(own.repartition(n, "own").sortWithinPartitions("own", "chunk").mapInPandas(pack, "own int, chunk long, rows binary"), "tiles")
    left = packed.select(F.col("own").alias("p"), F.col("chunk").alias("chunk"), F.col("rows").alias("a"))
    right = packed.select(F.col("own").alias("q"), F.col("chunk").alias("of"), F.col("rows").alias("b"))
    if has_shared:
        common = shared.withColumn("chunk", F.col("chunk").cast("long")).mapInPandas(alone, "chunk long, shared binary")
        left = left.join(common, "chunk", "left").select("p", "chunk", "a", "shared")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, sums = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.p, r.q) != cell:
                    if sums:
                        yield from sums.told()
                    cell, sums = (r.p, r.q), _Sums(item, names, r.p == r.q, diagonal)
                a = _read(r.a)
                b = a if r.p == r.q else _read(r.b)
                sums.add(a, b, kernel(a, b, _read(r.shared)) if has_shared else kernel(a, b))
        if sums:
            yield from sums.told()

    # A partition is a tile, and by the hint tasks read the partitions of either side. Of two tiles that meet twice, one meeting counts, by turns
    # the one and the other, so that each two partitions of the product have one.
    left, right = left.repartitionById(n, F.col("p")), right.repartitionById(n, F.col("q"))
    turn = F.when((F.col("p") + F.col("q")) % 2 == 0, F.col("p") <= F.col("q")).otherwise(F.col("p") > F.col("q"))
    cells = left.hint("shuffle_replicate_nl").join(right, turn & (F.col("chunk") == F.col("of"))).coalesce(math.ceil(n * n / 2))
    return cells.select("p", "q", "a", F.when(F.col("p") != F.col("q"), F.col("b")).alias("b"), *(["shared"] if has_shared else [])).mapInPandas(compare, f"i int, j int, {columns}")


#: Kinds of numbers in which a row is packed, and the value that stands for a missing one; the first that holds all values is taken.
_KINDS = [("1", np.int8, -128), ("2", np.int16, -32768), ("8", np.float64, np.nan)]


def _pack(at: np.ndarray, v: np.ndarray) -> bytes:
    v = np.asarray(v, np.float64)
    for name, kind, missing in _KINDS:
        if kind is np.float64 or (np.all(v == np.rint(v)) and np.all(np.abs(v) < -missing)):
            out = np.full(1 + int(np.max(at)), missing, kind)
            out[np.asarray(at, np.int64)] = v.astype(kind)
            return name.encode() + out.tobytes()


def packed_rows(values: DataFrame, item: str | None, feature: str, value: str) -> DataFrame:
    """item (if one is named), chunk, x: the values of SITES_AT_ONCE features in few bytes; feature: whole numbers from 0."""
    at = F.pmod(F.col(feature), F.lit(SITES_AT_ONCE)).cast("int")
    chunk = F.floor(F.col(feature) / SITES_AT_ONCE).alias("chunk")
    own = [item] if item else []
    rows = values.groupBy(*own, chunk).agg(F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("v"))).alias("x"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [_pack(at, v) for at, v in zip(b["at"], b["v"], strict=True)]
            yield b[[*own, "chunk"]].assign(x=x)

    ids = f"{item} {values.schema[item].dataType.simpleString()}, " if item else ""
    return rows.select(*own, "chunk", "x.at", "x.v").mapInPandas(pack, f"{ids}chunk long, x binary")


def _dense(x: pd.Series, wide: int) -> np.ndarray:
    """A matrix (row, place) of packed rows; missing is NaN."""
    out = np.full((len(x), wide), np.nan)
    for r, b in enumerate(x):
        kind, missing = next((k, m) for name, k, m in _KINDS if name == chr(b[0]))
        v = np.frombuffer(b, kind, offset=1)
        out[r, : len(v)] = np.where(v == missing, np.nan, v) if kind is not np.float64 else v
    return out


def products(values: DataFrame, item: str, feature: str, value: str, centers: DataFrame) -> DataFrame:
    """i <= j and s, the sum over features of the product of both items' values less the feature's center; absent ones are 0.

    centers: feature, center. They travel once a pair of tiles, so that an item's values stay the whole numbers they mostly are. feature: whole numbers from 0.
    """

    def kernel(a: pd.DataFrame, b: pd.DataFrame, common: pd.DataFrame) -> dict[str, np.ndarray]:
        center = _dense(common["x"], SITES_AT_ONCE)[0]
        x, y = (np.nan_to_num(_dense(g["x"], SITES_AT_ONCE) - center)[:, ~np.isnan(center)] for g in (a, b))
        return {"s": x @ y.T}

    return tiled_pairs(packed_rows(values, item, feature, value), item, kernel, "s double", diagonal=True, shared=packed_rows(centers, None, feature, "center"))


def _words(calls: DataFrame, item: str, other: str, homozygous: bool = False) -> DataFrame:
    """(item, block, mj, mn): presence of the site's major and minor allele over 64 of the other dimension."""
    s = site_stats(calls).select("site_id", "major", "minor")
    c = calls.join(s, "site_id")
    has = lambda k: F.coalesce((F.col("a1") == F.col(k)) | (F.col("a2") == F.col(k)), F.lit(False))
    ok = F.lit(True) if not homozygous else F.col("a1") == F.col("a2")
    at = F.pmod(F.col(other), F.lit(64))
    return c.groupBy(F.col(item), F.floor(F.col(other) / 64).alias("block")).agg(presence_bits(ok & has("major"), at).alias("mj"), presence_bits(ok & has("minor"), at).alias("mn"))


def _pairs(words: DataFrame, item: str, near: int | None = None) -> DataFrame:
    a = words.select(F.col(item).alias("i"), "block", F.col("mj").alias("mj1"), F.col("mn").alias("mn1"))
    b = words.select(F.col(item).alias("j"), "block", F.col("mj").alias("mj2"), F.col("mn").alias("mn2"))
    if near is None:
        return a.join(b, "block").where("i < j")
    # Within reach: both sides are dealt to bins of `near` items, the second to its own and the one before.
    a = a.withColumn("bin", F.floor(F.col("i") / near))
    b = b.withColumn("bin", F.explode(F.array(F.floor(F.col("j") / near), F.floor(F.col("j") / near) - 1)))
    return a.join(b, ["block", "bin"]).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= near))


def _n(x):
    return F.sum(F.bit_count(x).cast("long"))


def _word_matrix(g: pd.DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray]:
    mj, mn = np.zeros((len(g), wide), np.uint64), np.zeros((len(g), wide), np.uint64)
    for r, (at, x, y) in enumerate(zip(g["at"], g["mj"], g["mn"], strict=True)):
        mj[r, at], mn[r, at] = np.asarray(x, np.int64).view(np.uint64), np.asarray(y, np.int64).view(np.uint64)
    return mj, mn


def _shared_sites(a: pd.DataFrame, b: pd.DataFrame) -> dict[str, np.ndarray]:
    """Sites at which two taxa show a common allele, different ones, and both."""
    wide = 1 + max(int(np.max(x)) for x in (*a["at"], *b["at"]))
    (amj, amn), (bmj, bmn) = _word_matrix(a, wide), _word_matrix(b, wide)
    bmj, bmn = np.ascontiguousarray(bmj.T), np.ascontiguousarray(bmn.T)
    out = {k: np.zeros((len(a), len(b)), np.int64) for k in ("same", "diff", "het")}
    step = max(1, PAIRS_AT_ONCE // len(b))
    for r in range(0, len(a), step):
        at = slice(r, r + step)
        for w in range(wide):
            mj, mn = amj[at, w, None], amn[at, w, None]
            same, diff = (mj & bmj[w]) | (mn & bmn[w]), (mj & bmn[w]) | (mn & bmj[w])
            for k, x in (("same", same), ("diff", diff), ("het", same & diff)):
                out[k][at] += np.bitwise_count(x)
    return out


def ibs(calls: DataFrame, min_sites: int = 0, diagonal: bool = False, masked: DataFrame | None = None) -> DataFrame:
    """taxon_i < taxon_j, dist, sites: 1 - (same - het / 2) / (same + diff - het); null unless sites are over min_sites.

    diagonal: each taxon's distance to itself too, which its heterozygous calls keep from 0. masked: site_id of sites to leave out.
    """
    used = calls if masked is None else calls.join(masked.select("site_id"), "site_id", "leftanti")
    at = F.pmod(F.col("block"), F.lit(WORDS_AT_ONCE)).cast("int")
    rows = _words(used, "taxon_id", "site_id").groupBy("taxon_id", F.floor(F.col("block") / WORDS_AT_ONCE).alias("chunk")).agg(F.collect_list(F.struct(at.alias("at"), "mj", "mn")).alias("x"))
    p = tiled_pairs(rows.select("taxon_id", "chunk", "x.at", "x.mj", "x.mn"), "taxon_id", _shared_sites, "same long, diff long, het long", diagonal)
    sites = F.col("same") + F.col("diff") - F.col("het")
    return p.select(F.col("i").alias("taxon_i"), F.col("j").alias("taxon_j"), F.when((sites > 0) & (sites > min_sites), 1 - (F.col("same") - F.col("het") / 2) / sites).alias("dist"), sites.alias("sites"))


def ld(calls: DataFrame, window: int | None = 50, min_taxa: int = 20, homozygous: bool = False) -> DataFrame:
    """site_i < site_j, n, r2, d_prime, and the counts of the four combinations. window None compares all sites; else each with the next `window` ones.

    A heterozygous call counts for both alleles unless homozygous. Null where a minor count is under 2 or n under min_taxa.
    """
    p = _pairs(_words(calls, "site_id", "taxon_id", homozygous), "site_id", window)
    g = p.groupBy("i", "j").agg(*[_n(F.col(x + "1").bitwiseAND(F.col(y + "2"))).alias(x + "_" + y) for x in ("mj", "mn") for y in ("mj", "mn")])
    ab, aB, Ab, AB = (F.col(x).cast("double") for x in ("mn_mn", "mn_mj", "mj_mn", "mj_mj"))
    n = ab + aB + Ab + AB
    pa, pb = (Ab + AB) / n, (aB + AB) / n
    d = AB / n - pa * pb
    fine = (n >= min_taxa) & (ab + aB >= 2) & (ab + Ab >= 2) & (pa > 0) & (pa < 1) & (pb > 0) & (pb < 1)
    most = F.when(d < 0, F.least(pa * pb, (1 - pa) * (1 - pb))).otherwise(F.least(pa * (1 - pb), (1 - pa) * pb))
    return g.select(F.col("i").alias("site_i"), F.col("j").alias("site_j"), n.cast("long").alias("n"), F.when(fine, d * d / (pa * (1 - pa) * pb * (1 - pb))).alias("r2"), F.when(fine & (most > 0), F.abs(d) / most).alias("d_prime"), "mj_mj", "mj_mn", "mn_mj", "mn_mn")


def _call_distance(a: pd.DataFrame, b: pd.DataFrame) -> dict[str, np.ndarray]:
    x, y = (np.nan_to_num(_dense(g["x"], SITES_AT_ONCE), nan=-1).astype(np.int16) for g in (a, b))
    wide = 1 + max((int(np.flatnonzero((m >= 0).any(axis=0))[-1]) for m in (x, y) if (m >= 0).any()), default=0)
    x, y = x[:, :wide], y[:, :wide]
    hx, hy = x % 17 != 0, y % 17 != 0  # calls are 16 * lower + upper allele
    d, n = np.zeros((len(x), len(y)), np.int64), np.zeros((len(x), len(y)), np.int64)
    for r in range(len(x)):
        both = (x[r] >= 0) & (y >= 0)
        differ = both & (x[r] != y)
        n[r] = both.sum(axis=1)
        d[r] = differ.sum(axis=1) * 2 - (differ & (hx[r] | hy)).sum(axis=1)
    return {"d": d, "n": n}


def haplotype_distance(calls: DataFrame) -> DataFrame:
    """taxon_i < taxon_j, dist: over shared sites, two homozygous calls that differ count 2, a heterozygous call and another one 1, missing 0; pairs without a shared site have no row."""
    call = (F.least("a1", "a2") * 16 + F.greatest("a1", "a2")).cast("int")
    c = packed_rows(calls.where("a1 < 14 and a2 < 14").withColumn("call", call), "taxon_id", "site_id", "call")
    p = tiled_pairs(c, "taxon_id", _call_distance, "d long, n long")
    return p.where("n > 0").select(F.col("i").alias("taxon_i"), F.col("j").alias("taxon_j"), F.col("d").alias("dist"))


def kinship_features(calls: DataFrame) -> DataFrame:
    """site_id, allele, p: every allele but a site's last ranked one, and its share of the site's alleles."""
    s = site_stats(calls).select("site_id", "gametes", F.explode(F.slice("alleles", 1, F.greatest(F.size("alleles") - 1, F.lit(0)))).alias("x"))
    return s.select("site_id", F.col("x.allele").alias("allele"), (F.col("x.n") / F.col("gametes")).alias("p"))


def kinship(calls: DataFrame) -> DataFrame:
    """taxon_i <= taxon_j: sum over sites and alleles but the last ranked of centred dosages, over 2 * sum p (1 - p); missing is the mean."""
    s = row_numbers(kinship_features(calls), [F.col("site_id"), F.col("allele")], "feature")
    dosage = (F.col("a1") == F.col("allele")).cast("int") + (F.col("a2") == F.col("allele")).cast("int")
    d = calls.where("a1 < 14 and a2 < 14").join(s, "site_id").select("taxon_id", "feature", dosage.alias("w"))
    scale = s.agg((2 * F.sum(F.col("p") * (1 - F.col("p")))).alias("scale"))
    g = products(d, "taxon_id", "feature", "w", s.select("feature", (2 * F.col("p")).alias("center")))
    return g.join(F.broadcast(scale)).select(F.col("i").alias("taxon_i"), F.col("j").alias("taxon_j"), (F.col("s") / F.col("scale")).alias("k"))


def kinship_from_ibs(dist: DataFrame, ceiling: float = 2.0) -> DataFrame:
    """Similarity ceiling - dist, rescaled by the least one between different taxa."""
    s = dist.where("dist is not null").withColumn("s", ceiling - F.col("dist"))
    low = s.agg(F.min("s").alias("low"))
    return s.join(F.broadcast(low)).select("taxon_i", "taxon_j", ((F.col("s") - F.col("low")) * ceiling / (ceiling - F.col("low"))).alias("k"))


def fill_distances(dist: DataFrame) -> DataFrame:
    mean = dist.agg(F.avg("dist").alias("mean"))
    return dist.join(F.broadcast(mean)).select("taxon_i", "taxon_j", F.coalesce("dist", "mean").alias("dist"))


def squared_difference(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """The sum over pairs of two tables; without b, a has both distances (dist, d2), and no pair is shuffled."""
    both = a if b is None else a.join(b.select("taxon_i", "taxon_j", F.col("dist").alias("d2")), ["taxon_i", "taxon_j"])
    return both.agg(F.sum(F.pow(F.col("dist") - F.col("d2"), 2)).alias("squared"), F.count(F.lit(1)).alias("pairs"))


def _trait_rows(values: DataFrame) -> DataFrame:
    """taxon_id, at, v: the traits that a taxon has. Of equal taxa and traits the mean counts."""
    v = values.where("value is not null").groupBy("taxon_id", "trait").agg(F.avg("value").alias("value"))
    return v.groupBy("taxon_id").agg(F.collect_list("trait").alias("at"), F.collect_list("value").alias("v"))


def _trait_sums(a: pd.DataFrame, b: pd.DataFrame, squared: bool) -> dict[str, np.ndarray]:
    """Sum of the distances over the traits that both have, and their number."""
    names = {t: i for i, t in enumerate(sorted({t for at in (*a["at"], *b["at"]) for t in at}))}
    x, y = np.full((len(a), len(names)), np.nan), np.full((len(b), len(names)), np.nan)
    for m, g in ((x, a), (y, b)):
        for r, (at, value) in enumerate(zip(g["at"], g["v"], strict=True)):
            m[r, [names[t] for t in at]] = value
    s, n = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), np.int64)
    for r in range(len(x)):
        d = x[r] - y
        s[r], n[r] = np.nansum(d * d if squared else np.abs(d), axis=1), (~np.isnan(d)).sum(axis=1)
    return {"s": s, "n": n}


def trait_distance(values: DataFrame, squared: bool = False, of: DataFrame | None = None) -> DataFrame:
    """values: taxon_id, trait, value. Mean Manhattan or squared distance over the traits that both have; each pair once, or, with `of` (taxon_id), each of these with every other.

    Traits of a taxon are one row, as there are few beside sites; a task holds two tiles of taxa.
    """
    rows = _trait_rows(values).withColumn("chunk", F.lit(0).cast("long"))
    p = tiled_pairs(rows, "taxon_id", lambda a, b: _trait_sums(a, b, squared), "s double, n long").where("n > 0").select(F.col("i").alias("taxon_i"), F.col("j").alias("taxon_j"), (F.col("s") / F.col("n")).alias("dist"))
    if of is None:
        return p
    both = p.union(p.select("taxon_j", "taxon_i", "dist"))
    return both.join(small(of.select(F.col("taxon_id").alias("taxon_i")).distinct(), 16), "taxon_i", "leftsemi")


def nearest_with_trait(values: DataFrame, gaps: DataFrame, k: int, squared: bool = False) -> DataFrame:
    """taxon_i, trait, taxon_j, dist: for each gap (taxon_id, trait) the k nearest other taxa that have the trait, and some more; ties by taxon_j.

    A task compares a tile of the taxa with gaps with a tile of all taxa and returns the k nearest of that tile only.
    """
    every = materialize(_trait_rows(values), "traits")
    lacking = materialize(gaps.groupBy("taxon_id").agg(F.collect_set("trait").alias("lacks")).join(every, "taxon_id"), "gaps")
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t, u = tiles_of(lacking.count(), parts), tiles_of(every.count(), parts)
    deal = lambda n: F.pmod(F.xxhash64("taxon_id"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.array().cast("array<string>")
    a = lacking.select("taxon_id", "at", "v", "lacks", F.lit(True).alias("target"), deal(t).alias("p"), upto(u).alias("q"))
    b = every.select("taxon_id", "at", "v", none.alias("lacks"), F.lit(False).alias("target"), upto(t).alias("p"), deal(u).alias("q"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in _runs(batches, ["p", "q"]):
            a, b = g[g["target"]], g[~g["target"]]
            if not len(a) or not len(b):
                continue
            found = _trait_sums(a, b, squared)
            s, n, names = found["s"], found["n"], b["taxon_id"].to_numpy()
            has = {x: np.array([x in at for at in b["at"]]) for x in {x for lacks in a["lacks"] for x in lacks}}
            out = []
            for r, (taxon, lacks) in enumerate(zip(a["taxon_id"], a["lacks"], strict=True)):
                for trait in lacks:
                    at = np.flatnonzero(has[trait] & (n[r] > 0) & (names != taxon))
                    dist = s[r, at] / n[r, at]
                    if len(at) > k:
                        near = dist <= np.partition(dist, k - 1)[k - 1]
                        at, dist = at[near], dist[near]
                    first = np.lexsort((names[at], dist))[:k]
                    out += [(taxon, trait, names[at[x]], dist[x]) for x in first]
            yield pd.DataFrame(out, columns=["taxon_i", "trait", "taxon_j", "dist"])

    return a.unionByName(b).repartition(t * u, "p", "q").sortWithinPartitions("p", "q").mapInPandas(best, "taxon_i int, trait string, taxon_j int, dist double")
