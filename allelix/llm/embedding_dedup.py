"""Embedding near-deduplication with a forest of random-projection trees.

Equal vectors of a label are one class, so copies are never paired. Each tree splits recursively at the median of a
random projection (medians come from a bounded sample, `sample` vectors, 20,000 unless set; below the sample's reach
the split is at zero), and a vector whose projection is within `spill` of the split goes to both sides. Of a few random
directions the one with the fewest vectors on both sides is taken, and a node that no direction divides well, such as one
full of near copies, is a leaf. A label's vectors go down as many levels as leave about `leaf` of them in a leaf. Within each
leaf of a label all vectors are compared in double precision and the links' spanning edges are united over the trees. Last,
all vectors of a component are compared with each other, so the number of links is exact for each component. Leaves and
components over `block` vectors are compared block by block in separate tasks; that is quadratic in the largest component, as
the number of its links is.

The spill is in units of the spread that a pair at the threshold has along a random direction, sqrt(2 - 2 * threshold) /
sqrt(dimensions); with 0.75 of it on both sides about one in 250 of such pairs is parted by a split, so four trees of ten
levels lose under one in 100,000 of them, and pairs above the threshold less.

Defined results: a null label, a null, zero or empty vector, or one with null or non-finite parts links with nothing;
vectors of different length don't link; repeated rows link with each other, those with equal ids too; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small

#: Cosines this near the threshold are computed again with exact sums.
NEAR = 1e-12


def directions(dims: int, count: int, seed: int) -> np.ndarray:
    r = np.random.default_rng([seed, dims]).standard_normal((count, dims))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


class Tree:
    """Splits by node number (root 1, children 2n and 2n + 1): a direction and a threshold for each node that is divided.

    A node that the sample says isn't divided well is in `leaf_at`; nodes that the sample doesn't reach are divided at zero.
    """

    def __init__(self, sample: np.ndarray, depth: int, spill: float, seed: int, least: int = 32, tries: int = 4, most: float = 1.5):
        self.spill = spill
        self.axes = directions(sample.shape[1], 64, seed)
        self.at: dict[int, tuple[int, float]] = {}
        self.leaf_at: set[int] = set()
        nodes = {1: np.arange(len(sample))}
        for _ in range(depth):
            below = {}
            for node, rows in nodes.items():
                if len(rows) < least:
                    continue
                best = None
                for i in range(tries):
                    axis = self.axis(node, i)
                    p = sample[rows] @ self.axes[axis]
                    t = float(np.median(p))
                    both = int((np.abs(p - t) <= spill).sum())
                    if best is None or both < best[0]:
                        best = (both, axis, t, p)
                both, axis, t, p = best
                if len(rows) + both > most * len(rows):
                    self.leaf_at.add(node)
                    continue
                self.at[node] = (axis, t)
                below[2 * node], below[2 * node + 1] = rows[p <= t], rows[p > t]
            nodes = below

    def axis(self, node: int, i: int = 0) -> int:
        return ((node * 4 + i) * 2654435761 >> 7) % len(self.axes)

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row goes to; each row goes down depth levels at most."""
        rows, node, out_rows, out_nodes = np.arange(len(x)), np.ones(len(x), np.int64), [], []
        for level in range(int(depth.max(initial=0)) + 1):
            ended = (depth[rows] <= level) | np.isin(node, list(self.leaf_at))
            out_rows.append(rows[ended])
            out_nodes.append(node[ended])
            rows, node = rows[~ended], node[~ended]
            new_rows, new_nodes = [], []
            for n in np.unique(node):
                own = rows[node == n]
                axis, t = self.at.get(int(n), (self.axis(int(n)), 0.0))
                p = x[own] @ self.axes[axis] - t
                left, right = own[p <= self.spill], own[p > -self.spill]
                new_rows += [left, right]
                new_nodes += [np.full(len(left), 2 * n), np.full(len(right), 2 * n + 1)]
            if not new_rows:
                break
            rows, node = np.concatenate(new_rows), np.concatenate(new_nodes)
        return np.concatenate(out_rows), np.concatenate(out_nodes)


def raw(vectors) -> np.ndarray:
    return np.array([np.frombuffer(v, "<f8") for v in vectors])


def unit(vectors) -> np.ndarray:
    x = raw(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def hits(x: np.ndarray, rows: slice, vectors, threshold: float) -> np.ndarray:
    """Whether x[rows] and x have a cosine of at least the threshold; those nearest to it are settled by exact sums."""
    cosine = x[rows] @ x.T
    hit = cosine >= threshold
    start = rows.start or 0
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < NEAR), strict=True):
        a, b = sorted((start + i, j))
        hit[i, j] = _cosine(np.frombuffer(vectors[a], "<f8"), np.frombuffer(vectors[b], "<f8")) >= threshold
    return hit


def _stars(ids: np.ndarray, vectors, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links between the rows: each row with the first of its component, found by repeated minima over the links."""
    x, n = unit(vectors), len(ids)
    of = np.arange(n)
    linked = [np.nonzero(hits(x, slice(at, at + 512), vectors, threshold)) for at in range(0, n, 512)]
    i = np.concatenate([a + 512 * k for k, (a, _) in enumerate(linked)]) if n else np.zeros(0, np.int64)
    j = np.concatenate([b for _, b in linked]) if n else i
    i, j = i[i != j], j[i != j]
    while len(i):
        before = of.copy()
        np.minimum.at(of, i, of[j])
        np.minimum.at(of, of[i], of[j])
        of = of[of]
        if (of == before).all():
            break
    out = np.flatnonzero(of != np.arange(n))
    return ids[out], ids[of[out]]


def _blocked(keyed: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Adds a block pair (p, q, first): groups over `block` rows are dealt to all pairs of their blocks, others have one."""
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).alias("blocks"))
    counts = materialize(counts, "large-groups")
    n = counts.count()
    if not n:
        return keyed.withColumns({"p": F.lit(0), "q": F.lit(0), "own": F.lit(0)})
    own = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = keyed.join(small(counts, 64, n), keys, "left").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)).cast("int") - 1))
    return dealt.withColumn("o", other).withColumns({"p": F.least("own", "o"), "q": F.greatest("own", "o")}).drop("o", "blocks")


def near_dedup(vectors: DataFrame, threshold: float = 0.98, trees: int = 4, leaf: int = 32, block: int = 1024, spill: float = 0.75, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [np.asarray(x, "<f8") for x in b["v"]]
            v = [np.ldexp(x, -np.frexp(np.abs(x).max())[1]) for x in v]  # keeps huge and tiny vectors finite and is exact
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "label": b["label"], "v": [x.tobytes() for x in v]})

    numbered = given.where(F.coalesce(fine, F.lit(False))).mapInPandas(pack, "vec_id long, label string, v binary")
    packed = materialize(numbered.withColumns({"digest": F.sha2("v", 256), "row": F.monotonically_increasing_id()}), "vectors")
    odd = given.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = packed.groupBy("label", "digest").agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("dims", F.octet_length("v") / 8), "vector-classes")
    per = materialize(classes.groupBy("dims", "label").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
    levels = per.select("dims", "label", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / leaf))).cast("int").alias("depth"))
    edges = None
    for p in per.groupBy("dims").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect():  # one row per vector length
        own = classes.where(F.col("dims") == p["dims"]).join(small(levels, 60), ["dims", "label"])
        share = min(1.0, 1.2 * sample / p["n"])
        picked = own.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("v").limit(sample).toPandas()
        depth = max(0, math.ceil(math.log2(max(1.0, p["most"] / leaf))))
        apart = spill * math.sqrt(2 - 2 * threshold) / math.sqrt(p["dims"])
        start = unit(picked["v"]) if len(picked) else np.zeros((0, int(p["dims"])))
        forest = [Tree(start, depth, apart, seed + t) for t in range(trees if depth else 1)]

        def route(batches: Iterator[pd.DataFrame], forest=forest) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = unit(b["v"])
                    for t, tree in enumerate(forest):
                        rows, node = tree.leaves(x, b["depth"].to_numpy())
                        yield pd.DataFrame({"tree": t, "node": node, "label": b["label"].to_numpy()[rows], "rep": b["rep"].to_numpy()[rows], "v": b["v"].to_numpy()[rows]})

        routed = own.select("label", "rep", "v", "depth").mapInPandas(route, "tree int, node long, label string, rep long, v binary")
        # Leaves that hang together are one group, so that groups have some hundred rows; they are compared leaf by leaf.
        routed = routed.withColumn("above", F.shiftright("node", 3))

        def link(g: pd.DataFrame) -> pd.DataFrame:
            found = [_stars(x["rep"].to_numpy(), x["v"].to_numpy(), threshold) for _, x in g.groupby("node")]
            return pd.DataFrame({"u": np.concatenate([u for u, _ in found]), "v": np.concatenate([v for _, v in found])})

        found = _blocked(routed, ["tree", "label", "above"], block).groupBy("tree", "label", "above", "p", "q").applyInPandas(link, "u long, v long")
        edges = found if edges is None else edges.union(found)
    if edges is None:
        return odd
    nodes = materialize(components(edges), "components")
    joined = classes.select("rep", "m", "v").join(nodes, F.col("rep") == F.col("node")).select("rep", "m", "v", "component")

    def count(g: pd.DataFrame) -> pd.DataFrame:
        v, m = g["v"].to_numpy(), g["m"].to_numpy()
        x = unit(v)
        own, p, q = g["own"].to_numpy(), int(g["p"].iloc[0]), int(g["q"].iloc[0])
        n = np.zeros(len(g), np.int64)
        for at in range(0, len(g), 512):
            hit = hits(x, slice(at, at + 512), v, threshold)
            hit &= (own[at : at + 512, None] != own[None, :]) if p != q else True
            n[at : at + 512] = hit @ m
        if p == q:
            n -= m  # itself
        return pd.DataFrame({"rep": g["rep"], "n": n})

    linked = _blocked(joined, ["component"], block // 4).groupBy("component", "p", "q").applyInPandas(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    told = classes.select("label", "digest", "rep", "least", "m").join(nodes.select(F.col("node").alias("rep"), "component"), "rep", "left").join(linked, "rep", "left")
    told = materialize(told.select("label", "digest", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "vector-links")
    ids = materialize(told.groupBy("c").agg(F.min("least").alias("component_id")), "component-ids")
    told = told.join(small(ids, 24), "c").select("label", "digest", "n_links", "component_id")
    rows = packed.select("vec_id", "label", "digest").join(told, ["label", "digest"])
    return rows.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).union(odd)
