import numpy as np
from pyspark.sql import functions as F

from allelix.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, depth string"


def brute(ids, x, labels, threshold=0.98):
    x = np.array(x, np.float32).astype(float)
    with np.errstate(all="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    of = np.arange(len(x))
    while True:
        new = np.array([min(of[i], *(of[np.flatnonzero(hit[i])]), len(x)) if hit[i].any() else of[i] for i in range(len(x))])
        if (new == of).all():
            break
        of = new
    least = {c: min(ids[i] for i in np.flatnonzero(of == c)) for c in set(of)}
    return {ids[i]: (int(hit[i].sum()), least[of[i]]) for i in range(len(x))}


def made(seed, dims, n, labels):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    near = base[rng.integers(0, n, n // 2)] + rng.standard_normal((n // 2, dims)) * 0.19 * rng.uniform(0.2, 1.15, (n // 2, 1))
    hot = base[:1] + rng.standard_normal((150, dims)) * 0.08  # a dense group that no direction divides
    x = np.concatenate([base, near, hot])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    of = rng.integers(0, labels, len(x))
    of[rng.random(len(x)) < 0.4] = 0  # a label with most rows
    of[:1] = 0
    of[-150:] = 0
    return x, of


def test_forest_of_depth_three_and_more_against_all_pairs(spark):
    for dims in (8, 64):
        x, labels = made(dims, dims, 900, 3)
        ids = np.random.default_rng(1).permutation(len(x)) + 10
        rows = [(int(i), [float(f) for f in v], int(lab), "x", "y") for i, v, lab in zip(ids, x, labels, strict=True)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert np.log2(np.bincount(labels).max() / 16) > 5 and np.log2(np.bincount(labels).min() / 16) > 3
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_dedup(df, leaf=16, block=128).collect()}
        want = brute(ids, x, labels)
        assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_recall_of_single_trees():
    rng = np.random.default_rng(5)
    for dims in (8, 64, 256):
        a = rng.standard_normal((4000, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        d = rng.standard_normal((4000, dims))
        d -= (d * a).sum(1, keepdims=True) * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * d / np.linalg.norm(d, axis=1, keepdims=True)  # cosine 0.98, the hardest pairs
        met = np.zeros(4000, bool)
        for t in range(4):
            tree = E.Tree(a, 7, 0.75 * 0.2 / np.sqrt(dims), t)
            ends = [set(zip(*map(list, tree.leaves(x, np.full(4000, 7))), strict=True)) for x in (a, b)]
            rows = {r for r, _ in ends[0] & ends[1]}
            met[list(rows)] = True
        assert met.mean() > 0.999, dims


def test_odd_vectors_repeats_and_the_threshold(spark):
    inf, nan = float("inf"), float("nan")
    base = [1.0, 0.0, 0.0, 0.0]
    rows = [
        (1, base, 1), (1, base, 1), (2, [3e30, 0.0, 0.0, 0.0], 1), (3, base, 2), (4, base, None), (5, None, 1), (6, [0.0] * 4, 1), (7, [nan, 1.0, 0.0, 0.0], 1), (8, [inf, 0.0, 0.0, 0.0], 1), (9, [], 1),
        (10, [1.0, None, 0.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0, 0.0, 0.0], 1), (12, [0.0, 0.0, 49.0, 1.0], 1), (13, [0.0, 0.0, 49.0, 1.0], 1), (14, [1e-30, 0.0, 0.0, 0.0], 1),
    ]
    got = {}
    for r in E.near_dedup(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(3, 1, True)] * 2 and got[2] == [(3, 1, False)] and got[14] == [(3, 1, False)] and got[3] == [(0, 3, True)]
    assert all(got[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == [(0, None, True)]
    assert got[12] == [(1, 12, True)] and got[13] == [(1, 12, False)]
    # 49 : 7 * 7 / 50 is a cosine of exactly 0.98
    pair = spark.createDataFrame([(1, [1.0, 0.0], 1, "", ""), (2, [49.0, float(np.sqrt(50**2 - 49**2))], 1, "", ""), (3, [48.9, 10.0], 1, "", "")], "vec_id long, embedding array<double>, label int, a string, b string")
    exact = {r.vec_id: r.n_links for r in E.near_dedup(pair, leaf=1).collect()}
    above = lambda a, b: E._cosine(np.array(a), np.array(b)) >= 0.98
    assert (exact[2] >= 1) == (above([1.0, 0.0], [49.0, np.sqrt(99)]) or above([48.9, 10.0], [49.0, np.sqrt(99)]))
    assert E.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert E.near_dedup(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).where(F.col("vec_id") == 5)).count() == 1


def test_huge_and_tiny_vectors_link(spark):
    rows = [(1, [1e308, 1e308]), (2, [9e307, 9e307]), (3, [1.7e308, 0.0]), (4, [5e-324, 5e-324]), (5, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in E.near_dedup(df).collect()} == {1: (3, 1), 2: (3, 1), 3: (0, 3), 4: (3, 1), 5: (3, 1)}
