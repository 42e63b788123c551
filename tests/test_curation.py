import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.operators import association, curation


def test_depth_codes_are_exact_to_182_and_near_beyond(spark):
    r = spark.range(1, 9000).withColumn("d", F.col("id").cast("int")).withColumn("code", curation.encoded_depth("d"))
    r = r.withColumn("back", curation.decoded_depth("code")).collect()
    assert all(-128 <= x["code"] <= 127 for x in r)
    assert all(x["d"] == x["back"] for x in r if x["d"] <= 182)
    assert all(abs(x["d"] - x["back"]) <= 0.05 * x["d"] + 1 for x in r)


def test_aligned_ends(spark):
    rows = [("10M", 5, 5, 14), ("3S10M2I4D2S", 100, 97, 115), ("5M1I5M", 1, 1, 10)]
    d = spark.createDataFrame(rows, "cigar string, pos int, s int, e int")
    start, end = curation.aligned_ends()
    assert all(r["s"] == r["a"] and r["e"] == r["b"] for r in d.select("s", "e", start.alias("a"), end.alias("b")).collect())


def test_same_tag_sites_walk_from_leader_to_leader(spark):
    p = spark.createDataFrame([(0, 1, 10), (1, 1, 20), (2, 1, 60), (3, 1, 90), (4, 1, 300), (5, 2, 310)], "site_id int, chrom int, pos int")
    ld = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.9), (2, 3, 0.95), (4, 5, 1.0)], "site_i int, site_j int, r2 double")
    assert sorted(r[0] for r in curation.same_tag_sites(p, ld, 0.8).collect()) == [0, 2, 4, 5]
    assert curation.same_tag_sites(p.limit(0), ld, 0.8).count() == 0


def test_merge_duplicate_sites(spark):
    one = {1: (0, 0), 2: (1, 1), 3: (15, 15), 4: (0, 1)}
    two = {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (1, 0)}  # agrees with the first one where both have a call
    far = {1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (0, 1)}  # same alleles, other calls
    rows = [(t, s, *c) for s, x in ((7, one), (8, two), (9, far), (20, one)) for t, c in x.items()]
    calls = spark.createDataFrame(rows, "taxon_id int, site_id int, a1 int, a2 int")
    p = spark.createDataFrame([(7, 1, 50), (8, 1, 50), (9, 1, 50), (20, 1, 90)], "site_id int, chrom int, pos int")
    got = {(r["site_id"], r["taxon_id"]): (r["a1"], r["a2"]) for r in curation.merge_duplicate_sites(calls, p).collect()}
    assert {s for s, _ in got} == {7, 9, 20}
    assert [got[7, t] for t in (1, 2, 3, 4)] == [(0, 0), (1, 1), (1, 1), (0, 1)]
    assert [got[20, t] for t in (1, 2, 3, 4)] == list(one.values())
    loose = {(r["site_id"], r["taxon_id"]): (r["a1"], r["a2"]) for r in curation.merge_duplicate_sites(calls, p, 1.0).collect()}
    assert {s for s, _ in loose} == {7, 20} and loose[7, 1] == (0, 1)


def test_pedigree_kinship():
    a = association.pedigree_kinship(np.array([[-1, -1], [-1, -1], [0, 1], [0, 1], [2, 3], [0, -1]]))
    assert a[2, 3] == 0.5 and a[0, 2] == 0.5 and a[4, 4] == 1.25 and a[0, 4] == 0.5 and a[0, 5] == 0.5 and a[1, 5] == 0
    with pytest.raises(ValueError):
        association.pedigree_kinship(np.array([[1, -1], [-1, -1]]))


def test_estimates_with_a_factor_find_planted_effects(spark):
    rows = [(t, "x", 10.0 * t + 3.0 * e, f"e{e}") for t in range(5) for e in range(3) if (t, e) != (2, 1)] + [(1, "x", None, "e0")]
    got = association.estimates_by_taxon(spark.createDataFrame(rows, "taxon_id int, trait string, value double, env string"), ["env"]).collect()
    assert {r["taxon_id"]: (r["n"], round(r["blue"], 6)) for r in got} == {t: (2 if t == 2 else 3, 10.0 * t + 3.0) for t in range(5)}


def test_mixed_association_equals_generalised_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 40
    w = rng.standard_normal((n, 30))
    k = w @ w.T / 30
    g = rng.integers(0, 2, (n, 3))
    g[:, 2] = 0
    y = 1.5 * g[:, 1] + np.linalg.cholesky(k + 0.5 * np.eye(n)) @ rng.standard_normal(n)
    calls = spark.createDataFrame([(t, s, int(g[t, s]), int(g[t, s])) for t in range(n) for s in range(3) if (t, s) != (4, 1)], "taxon_id int, site_id int, a1 int, a2 int")
    values = spark.createDataFrame([(t, float(y[t])) for t in range(n)], "taxon_id int, value double")
    got = {r["site_id"]: r for r in association.mixed_association(calls, values, list(range(n)), k).collect()}
    delta, genetic, _ = association.emma(y, np.ones((n, 1)), k)
    for s, keep in ((0, list(range(n))), (1, [t for t in range(n) if t != 4])):
        v = np.linalg.inv((genetic * (k + delta * np.eye(n)))[np.ix_(keep, keep)])
        x = np.column_stack([np.ones(len(keep)), g[keep, s]])
        inv = np.linalg.inv(x.T @ v @ x)
        b = inv @ x.T @ v @ y[keep]
        assert got[s]["n"] == len(keep) and got[s]["df"] == 1
        assert abs(got[s]["f"] - b[1] ** 2 / inv[1, 1]) < 1e-6
    assert got[2]["df"] == 0 and got[2]["f"] is None and got[1]["p"] < got[0]["p"]


def test_mixed_association_of_calls_needs_no_taxa_sized_matrix(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 90
    rows = [(t, s, *((15, 15) if rng.random() < 0.2 or t == 5 and s < 6 else (int(x), int(x if rng.random() < 0.7 else 1))))
            for t in range(n) for s in range(7) for x in [rng.integers(0, 2 if s < 6 else 1)]]
    rows = [(t, s, a, 0 if s == 6 and a < 14 else b) for t, s, a, b in rows if (t, s) != (4, 1)] + [(n, 0, 0, 1), (n, 7, 1, 1)]
    calls = spark.createDataFrame(rows, "taxon_id int, site_id int, a1 int, a2 int")
    values = spark.createDataFrame([(t, None if t % 11 == 3 else float(t % 9 + rng.standard_normal())) for t in range(n)] + [(1, 4.0)], "taxon_id int, value double")
    names, k = association.matrix(association.kinship(calls), "k")
    want = {r["site_id"]: r for r in association.mixed_association(calls, values, names, np.nan_to_num(k)).collect()}

    def refused(*_):
        raise AssertionError("a taxa-sized matrix")

    monkeypatch.setattr(association, "matrix", refused)
    monkeypatch.setattr(association, "TASK_TAXA", 20)
    for room in (association.SUMS_BYTES, 600):  # one block of sites and several
        monkeypatch.setattr(association, "SUMS_BYTES", room)
        got = {r["site_id"]: r for r in association.mixed_association_of_calls(calls, values).collect()}
        assert set(got) == set(want) == set(range(7)) and sum(r["df"] > 1 for r in want.values()) > 3
        for s, r in want.items():
            assert (r["n"], r["df"], r["f"] is None) == (got[s]["n"], got[s]["df"], got[s]["f"] is None)
            if r["f"] is not None:
                assert all(abs(r[c] - got[s][c]) < 1e-6 * max(1, abs(r[c])) for c in ("f", "p", "r2"))


def test_binomial_tail(spark):
    from math import comb

    rows = [(k, n, p) for n in (1, 5, 30) for k in range(0, n + 1, max(1, n // 5)) for p in (0.1, 0.5, 0.9)]
    d = spark.createDataFrame(rows, "k int, n int, p double").withColumn("c", association.binomial_cdf(F.col("k"), F.col("n"), F.col("p")))
    for r in d.collect():
        assert abs(r["c"] - sum(comb(r["n"], i) * r["p"] ** i * (1 - r["p"]) ** (r["n"] - i) for i in range(r["k"] + 1))) < 1e-9
