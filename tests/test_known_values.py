"""Models that SQL can't express, held against exact or plain computations."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.functions.stats import het_thresholds
from allelix.operators import models, quality, reads, sites

CALLS = "taxon_id int, site_id int, a1 int, a2 int"


def calls(spark, taxa=40, n=12, seed=1):
    rng = random.Random(seed)
    rows = []
    for t in range(taxa):
        for s in range(n):
            a = rng.choice([0, 0, 1])
            rows.append((t, s, *rng.choice([(a, a), (a, a), (0, 1), (15, 15)])))
    return rows, spark.createDataFrame(rows, CALLS)


def test_glm_is_the_test_by_sums(spark):
    rng = random.Random(2)
    _, c = calls(spark)
    v = spark.createDataFrame([(t, "x", rng.gauss(t % 3, 1)) for t in range(40)] + [(40, "x", None)], "taxon_id int, trait string, value double")
    a = {r.site_id: r for r in models.glm(c, v).collect()}
    b = {r.site_id: r for r in sites.association_by_sums(c, v).collect()}
    assert a.keys() == b.keys() and len(a) == 12
    for s in a:
        assert a[s].f == pytest.approx(b[s].f) and (a[s].df, a[s].error_df, a[s].n) == (b[s].df, b[s].error_df, b[s].n) and a[s].r2 == pytest.approx(b[s].r2)


def exact_fisher(a, b, c, d):
    r, s, k = a + b, c + d, a + c
    of = lambda x: Fraction(math.comb(r, x) * math.comb(s, k - x), math.comb(r + s, k))
    every = [of(x) for x in range(max(0, k - s), min(r, k) + 1)]
    return float(sum(p for p in every if p <= of(a)))


def test_fisher_of_a_table_of_counts(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randint(0, 12) for _ in range(4)) for _ in range(200)] * 2 + [(0, 0, 0, 0), (60, 40, 30, 70)]
    got = models.with_fisher(spark.createDataFrame(rows, "mj_mj long, mj_mn long, mn_mj long, mn_mn long")).collect()
    for r in got:
        assert r.p == pytest.approx(exact_fisher(*r[:4]), rel=1e-9)


def test_depth_thresholds_and_calls(spark):
    """The least minor depth whose upper tail under a half isn't rarer than under the error, by exact sums; and the rule in a loop."""
    e = Fraction(1, 100)
    pmf = lambda k, n, p: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    want, t = [], 0
    for n in range(80):
        while t < n and sum(pmf(k, n, Fraction(1, 2)) for k in range(t + 1)) <= sum(pmf(k, n, e) for k in range(t, n + 1)):
            t += 1
        want.append(t)
    assert het_thresholds(80).tolist() == want
    rng = random.Random(4)
    rows = [(i, 0, [rng.choice([0, 0, rng.randint(0, 3), rng.randint(0, 70)]) for _ in range(4)]) for i in range(300)]
    got = reads.call_by_depth(spark.createDataFrame(rows, "taxon_id int, site_id int, depth array<int>"), 80).collect()
    for r in got:
        depth = rows[r.taxon_id][2]
        first, second = sorted(range(4), key=lambda k: (-depth[k], k))[:2]
        total = depth[first] + depth[second]
        het = depth[first] == depth[second] if total >= 80 else depth[second] >= max(1, want[total])
        assert (r.a1, r.a2) == ((15, 15) if depth[first] == 0 else (first, second) if het else (first, first)), depth


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    paths = np.array(list(itertools.product(range(3), repeat=8)))
    for _ in range(30):
        start, t, e = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.random((8, 3))
        score = np.log(start)[paths[:, 0]] + np.log(e[np.arange(8), paths]).sum(axis=1) + np.log(t[paths[:, :-1], paths[:, 1:]]).sum(axis=1)
        assert (models.viterbi(start, t, e) == paths[score.argmax()]).all()


def test_permutations_of_residuals(spark):
    """With a factor, each permutation's least p is that of plain least squares on the fitted values and permuted residuals."""
    from allelix.functions.stats import f_test

    rows, c = calls(spark, 30, 4, 6)
    rng = random.Random(7)
    v = [(t, rng.gauss(2 * (t % 2), 1), t % 2) for t in range(30)]
    got = {r.permutation: r.min_p for r in models.glm_permutations(c, spark.createDataFrame(v, "taxon_id int, value double, g int"), 5, 9, ["g"]).collect()}
    y, g = np.array([x[1] for x in v]), np.array([x[2] for x in v])
    means = np.array([y[g == k].mean() for k in (0, 1)])[g]
    draws = np.random.default_rng(9)
    for p in range(5):
        z = draws.permutation(y - means) + means
        best = 1.0
        for s in range(4):
            own = [(t, (min(a, b), max(a, b))) for t, site, a, b in rows if site == s and a < 14]
            at = [t for t, _ in own]
            kinds = sorted({k for _, k in own})
            base = np.stack([np.ones(len(at)), g[at]], axis=1)
            full = np.hstack([base, np.array([[k == kind for kind in kinds[1:]] for _, k in own], float).reshape(len(at), -1)])
            rss = [float(((z[at] - x @ np.linalg.lstsq(x, z[at], rcond=None)[0]) ** 2).sum()) for x in (base, full)]
            df, error = np.linalg.matrix_rank(full) - np.linalg.matrix_rank(base), len(at) - np.linalg.matrix_rank(full)
            best = min(best, f_test((rss[0] - rss[1]) / df / (rss[1] / error), int(df), int(error)))
        assert got[p] == pytest.approx(best, rel=1e-6)
    assert c.where(F.col("a1") > 15).count() == 0


def test_contingency_permutations(spark):
    """Two rows and columns give the exact test's p but for chance; the same table gives the same p; a table of one row gives 1."""
    tables = [[[3, 9], [8, 2]], [[10, 10], [11, 9]], [[5, 0], [0, 5]], [[4, 5, 6]], [[1, 2], [0, 0]], [[3, 9], [8, 2]]]
    got = {r.id: r.p for r in quality.contingency_permutations(spark.createDataFrame(list(enumerate(tables)), "id int, counts array<array<int>>"), 20_000).collect()}
    for i in (0, 1, 2):
        (a, b), (c, d) = tables[i]
        assert got[i] == pytest.approx(exact_fisher(a, b, c, d), abs=0.012)
    assert got[3] == 1 and got[4] == 1 and got[5] == got[0]
    three = {r.id: r.p for r in quality.contingency_permutations(spark.createDataFrame([(0, [[9, 1, 1], [1, 9, 1], [1, 1, 9]]), (1, [[4, 4, 4], [4, 4, 4]])], "id int, counts array<array<int>>"), 2000).collect()}
    assert three[0] < 0.001 and three[1] > 0.9
