"""Clusters of haplotypes by window of sites under missing calls: a haplotype may agree with several clusters and then belongs to each in part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialize, small
from .quality import blocks


def clusters_of(calls: np.ndarray) -> list[list[tuple[int, float]]]:
    """(row, share) of the members of each cluster, seeds first. Rows are taken in the given order; calls are whole numbers, missing ones -1.

    A row that differs in a known call from all seeds is a seed. Every other row joins each cluster with none of whose members it
    differs, with an equal share. Members of a cluster don't differ from each other, so that their known calls together are one row
    for them all.
    """
    known = np.full_like(calls, -1)  # of each seed's cluster, in the order of the seeds
    fits = lambda row, n: np.flatnonzero(((row < 0) | (known[:n] < 0) | (known[:n] == row)).all(axis=1))
    out: list[list[tuple[int, float]]] = []
    rest = []
    for i, row in enumerate(calls):
        if len(fits(row, len(out))):
            rest.append(i)
        else:
            known[len(out)] = row
            out.append([(i, 1.0)])
    for i in rest:
        at = fits(calls[i], len(out))
        known[at] = np.where(calls[i] < 0, known[at], calls[i])
        for c in at:
            out[c].append((i, 1.0 / len(at)))
    return out


def haplotype_clusters(calls: DataFrame, positions: DataFrame, window_sites: int) -> DataFrame:
    """chrom, block, cluster, score, taxon_id, share, seed: the clusters of each window by falling score (ties: the smaller seed), from 0.

    Taxa with most calls are taken first, ties by taxon. A cluster's score is the sum of its members' shares. Taxa with the same known
    calls in a window join the same clusters, so a task takes a window's different haplotypes, each once, and taxa are joined to them.
    """
    sites = blocks(positions.select("site_id", "chrom", "pos"), window_sites).select("site_id", "chrom", "block")
    call = F.when((F.col("a1") < 14) & (F.col("a2") < 14), F.concat_ws(":", "site_id", F.least("a1", "a2") * 16 + F.greatest("a1", "a2")))
    taxa = calls.join(sites, "site_id").groupBy("chrom", "block", "taxon_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list(call))).alias("known"))
    taxa = materialize(taxa, "haplotypes")
    haps = taxa.groupBy("chrom", "block", "known").agg(F.min("taxon_id").alias("first"), F.count(F.lit(1)).alias("n"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        told = [[tuple(map(int, c.split(":"))) for c in known.split()] for known in g["known"]]
        names = {s: i for i, s in enumerate(sorted({s for row in told for s, _ in row}))}
        m = np.full((len(g), len(names)), -1, np.int64)
        for i, row in enumerate(told):
            for s, c in row:
                m[i, names[s]] = c
        first, n, known = (g[c].to_numpy() for c in ("first", "n", "known"))
        order = np.lexsort((first, -(m >= 0).sum(axis=1)))
        found = [[(order[i], s) for i, s in c] for c in clusters_of(m[order])]
        scores = [round(float(sum(s * n[i] for i, s in c)), 9) for c in found]
        rank = sorted(range(len(found)), key=lambda k: (-scores[k], int(first[found[k][0][0]])))
        out = [(at, scores[k], known[i], s, int(first[found[k][0][0]])) for at, k in enumerate(rank) for i, s in found[k]]
        return pd.DataFrame(out, columns=["cluster", "score", "known", "share", "of"]).assign(chrom=g["chrom"].iloc[0], block=g["block"].iloc[0])

    found = haps.groupBy("chrom", "block").applyInPandas(one, "cluster int, score double, known string, share double, of int, chrom int, block int")
    found = small(materialize(found, "haplotype-clusters"), 60 + 8 * window_sites)
    return taxa.join(found, ["chrom", "block", "known"]).select("cluster", "score", "taxon_id", "share", (F.col("taxon_id") == F.col("of")).alias("seed"), "chrom", "block")
