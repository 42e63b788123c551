"""Clusters of haplotypes against a loop over pairs; projection files that don't hold what they say."""

import random
import time

import numpy as np
import pytest

from allelix.operators import haplotype_clusters as H
from allelix.sources.projections import read_projection


def apart(a, b):
    d = 0
    for x, y in zip(a, b, strict=True):
        if None not in (x, y) and x != y:
            d += 1 if x[0] != x[1] or y[0] != y[1] else 2
    return d


def plain(haps):
    order = sorted(haps, key=lambda t: (-sum(c is not None for c in haps[t]), t))
    seeds, rest = [], []
    for t in order:
        (rest if any(apart(haps[t], haps[s]) == 0 for s in seeds) else seeds).append(t)
    clusters = {s: [s] for s in seeds}
    shares = {s: {s: 1.0} for s in seeds}
    for t in rest:
        at = [s for s in seeds if all(apart(haps[t], haps[m]) == 0 for m in clusters[s])]
        for s in at:
            clusters[s].append(t)
            shares[s][t] = 1 / len(at)
    score = {s: round(sum(shares[s].values()), 9) for s in seeds}
    rank = sorted(seeds, key=lambda s: (-score[s], s))
    return {(n, score[s], t, round(x, 9), t == s) for n, s in enumerate(rank) for t, x in shares[s].items()}


def test_clusters_are_those_of_a_loop(spark):
    rng = random.Random(1)
    calls, haps = [], {}
    for t in range(30):
        for s in range(12):
            a = rng.choice([0, 0, 0, 1])
            c = (15, 15) if rng.random() < 0.4 else (a, a) if rng.random() < 0.9 else (0, 1)
            calls.append((t, s, *c))
            haps.setdefault((s // 6, t), []).append(None if c[0] == 15 else tuple(sorted(c)))
    pos = spark.createDataFrame([(s, 1, 10 * s) for s in range(12)], "site_id int, chrom int, pos int")
    got = H.haplotype_clusters(spark.createDataFrame(calls, "taxon_id int, site_id int, a1 int, a2 int"), pos, 6).collect()
    for block in (0, 1):
        want = plain({t: h for (b, t), h in haps.items() if b == block})
        assert {(r.cluster, r.score, r.taxon_id, round(r.share, 9), r.seed) for r in got if r.block == block} == want and len(want) > 30


def test_many_equal_haplotypes_are_not_compared_pair_by_pair(spark):
    at = time.time()
    found = H.clusters_of(np.array([[0, 0, 17]] * 20_000 + [[17, 0, 17], [-1, 0, 17]]))
    assert time.time() - at < 5
    assert [len(c) for c in found] == [20_001, 2] and found[0][-1] == found[1][-1] == (20_001, 0.5)
    calls = spark.range(6000).selectExpr("cast(id as int) taxon_id", "explode(sequence(0, 3)) site_id").selectExpr("taxon_id", "site_id", "case when site_id = 3 and taxon_id % 3 = 2 then 15 else (taxon_id % 3) * cast(site_id = 3 as int) end a1").selectExpr("*", "a1 a2")
    got = H.haplotype_clusters(calls, spark.createDataFrame([(s, 1, s) for s in range(4)], "site_id int, chrom int, pos int"), 4).groupBy("cluster", "score", "share", "seed").count().collect()
    assert {tuple(r) for r in got} == {(c, 3000.0, *x) for c in (0, 1) for x in ((1.0, True, 1), (1.0, False, 1999), (0.5, False, 2000))}


@pytest.mark.parametrize("text", ["", "2\t1\n0\ta\nt\t1:1:5:0:0\n", "1\t1\n0\ta\nt\t1:1:5:0:3\n"])
def test_files_that_are_refused(spark, tmp_path, text):
    (tmp_path / "p").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        read_projection(spark, str(tmp_path / "p")).collect()


def test_file_with_no_hypothesis_and_comments(spark, tmp_path):
    (tmp_path / "p").write_text("2\t3\n#Donors\n0\tB73\n1\t7\nx y\t1:5:9:0:1\t2:1:3:-1:1\nempty\t\nz\t1:1:2:1:1\t\n")
    got = {tuple(r) for r in read_projection(spark, str(tmp_path / "p")).collect()}
    assert got == {("x y", "1", 5, 9, "B73", "7"), ("x y", "2", 1, 3, None, "7"), ("z", "1", 1, 2, "7", "7")}
