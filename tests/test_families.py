"""The five-state model against all paths, and families whose true states are known."""

import itertools
import random

import numpy as np

from allelix.operators import families as M


def test_paths_are_the_best_of_all():
    rng = np.random.default_rng(1)
    paths = np.array(list(itertools.product(range(5), repeat=8)))
    start, t, e = np.full(5, 0.2), np.array(M.TRANSITION), np.array(M.EMISSION)
    seen = [rng.integers(0, 3, 8) for _ in range(12)] + [rng.integers(0, 3, n) for n in (1, 3, 5)]
    pos = [np.cumsum(rng.integers(1, 4000, len(s))) for s in seen]
    got = M.best_states(seen, pos, t, e, start, 300.0)
    for s, p, states in zip(seen, pos, got, strict=True):
        every = np.unique(paths[:, : len(s)], axis=0)
        score = np.log(start)[every[:, 0]] + np.log(e)[every, s[None]].sum(axis=1)
        for i in range(1, len(s)):
            step = np.log(M.step_matrices(t, np.array([p[i] - p[i - 1]]), 300.0))[0]
            score = score + step[every[:, i - 1], every[:, i]]
        mine = next(k for k in range(len(every)) if (every[k] == states).all())
        assert score[mine] >= score.max() - 1e-9


def test_distance_changes_the_transitions():
    near, far = M.step_matrices(np.array(M.TRANSITION), np.array([1, 10_000]), 100.0)
    assert near[0, 4] < far[0, 4] < 0.5 and np.allclose(near.sum(axis=1), 1)
    assert np.allclose(M.step_matrices(np.array(M.TRANSITION), np.array([100]), 100.0)[0][0, 1:], M.TRANSITION[0][1:])


def plain(seen, pos, sites, heterozygous, rounds=50):
    """The rounds of one family and chromosome, a taxon at a time."""
    hom = (1 - heterozygous) / 2
    t, e, start = np.array(M.TRANSITION), np.array(M.EMISSION), np.array([hom, heterozygous / 4, heterozygous / 2, heterozygous / 4, hom])
    span = max(p.max() for p in pos) - min(p.min() for p in pos)
    segment, before = max(1.0, span // sites), None
    for _ in range(rounds):
        states = [M.best_states([s], [p], t, e, start, segment)[0] if len(s) >= 20 else 2 * s for s, p in zip(seen, pos, strict=True)]
        changes, shown = np.zeros((5, 5)), np.zeros((5, 3))
        for s, x in zip(seen, states, strict=True):
            for a, b in zip(x, x[1:]):
                changes[a, b] += 1
            for a, b in zip(x, s, strict=True):
                shown[a, b] += 1
        if before is not None and (before == shown).all():
            break
        before = shown
        for k in range(5):
            t[k] = changes[k] / changes[k].sum() if changes[k].sum() else t[k]
            e[k] = shown[k] / shown[k].sum() if shown[k].sum() else e[k]
        start, segment = shown.sum(axis=1) / shown.sum(), span * len(seen) / changes.sum()
    return states


def made(seed, family, taxa=14, sites=80):
    """True states with a few changes, calls with errors and gaps."""
    rng = random.Random(seed)
    truth, rows = {}, []
    for t in range(taxa):
        taxon, state = 100 * family + t, rng.choice([0, 2, 4])
        for s in range(sites):
            if rng.random() < 0.02:
                state = rng.choice([0, 2, 4])
            truth[taxon, s] = state
            if t == 0 and s > 10:
                continue  # too few calls
            if rng.random() < 0.75:
                x = {0: 0, 2: rng.choice([0, 1, 2]), 4: 2}[state]
                rows.append((taxon, s, x if rng.random() > 0.02 else rng.randrange(3)))
    return truth, rows


def test_families_against_a_loop(spark):
    truth, rows = {}, []
    for f in (1, 2):
        a, b = made(f, f)
        truth |= a
        rows += b
    calls = spark.createDataFrame([*rows, (100, 79, None)], "taxon_id int, site_id int, state int")
    pos = spark.createDataFrame([(s, 1 + s // 50, 1000 + 137 * s) for s in range(80)], "site_id int, chrom int, pos int")
    fam = spark.createDataFrame([(100 * f + t, f) for f in (1, 2) for t in range(14)], "taxon_id int, family int")
    got = {(r.taxon_id, r.site_id): r.state for r in M.five_state_impute(calls, pos, fam, 0.3).collect()}
    assert got.keys() == {(t, s) for t, s, _ in rows}
    for f in (1, 2):
        for chrom, lo, hi in ((1, 0, 50), (2, 50, 80)):
            taxa = sorted({t for t, s, _ in rows if t // 100 == f and lo <= s < hi})
            of = {t: sorted((s, x) for u, s, x in rows if u == t and lo <= s < hi) for t in taxa}
            want = plain([np.array([x for _, x in of[t]]) for t in taxa], [np.array([1000 + 137 * s for s, _ in of[t]]) for t in taxa], hi - lo, 0.3)
            for t, states in zip(taxa, want, strict=True):
                assert [got[t, s] for s, _ in of[t]] == list(states), (f, chrom, t)
    code = lambda s: 0 if s == 0 else 2 if s == 4 else 1
    right = sum(code(got[c]) == code(truth[c]) for c in got)
    shown = sum(x == code(truth[t, s]) for t, s, x in rows)
    assert right > shown and right > 0.9 * len(rows)


def test_map_positions(spark):
    pos = spark.createDataFrame([(1, 1, 50), (2, 1, 150), (3, 1, 350)], "site_id int, chrom int, pos int")
    rates = spark.createDataFrame([(1, 100, 0.5), (1, 200, 2.0)], "chrom int, pos int, rate double")
    assert {r.site_id: r.pos for r in M.map_positions(pos, rates).collect()} == {1: -25.0, 2: 25.0, 3: 350.0}


def test_parent_calls(spark):
    states = spark.createDataFrame([(1, 1, 7, 0), (2, 1, 7, 3), (3, 1, 7, 4)], "taxon_id int, site_id int, family int, state int")
    parents = spark.createDataFrame([(7, 1, 2, 3)], "family int, site_id int, first int, second int")
    assert {r.taxon_id: (r.a1, r.a2) for r in M.parent_calls(states, parents).collect()} == {1: (2, 2), 2: (2, 3), 3: (3, 3)}
