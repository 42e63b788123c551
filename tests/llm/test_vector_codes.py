import hashlib
import math
import random

import pytest

from allelix.llm import vector_codes
from allelix.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, embedding) -> the rows, by one loop over all vectors."""
    kept = [(i, la, [math.floor(256 * x) for x in e]) for i, la, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * dim : (p + 1) * dim]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min(range(len(books[p])), key=lambda k: (dist(cut(v, p), books[p][k]), k))
    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            for p in range(parts):
                groups.setdefault((p, pick(v, p)), []).append(cut(v, p))
        for (p, k), g in groups.items():
            books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], {}
    for i, la, v in kept:
        ks = [pick(v, p) for p in range(parts)]
        err = sum(dist(cut(v, p), books[p][k]) for p, k in enumerate(ks))
        by[la] = by.get(la, 0) + err
        out.append((i, la, "".join(f"{k:02x}" for k in ks), err))
    return sorted(((i, c, e, by[la], sha) for i, la, c, e in out), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def told(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, la, 1, "x") for i, la, e in rows], SCHEMA)
    return sorted(map(tuple, vector_codes.compress(df, **kw).collect()), key=repr)


def vectors(n, dim, seed):
    rng = random.Random(seed)
    hot = [rng.choice([-0.5, 0.25, 1 / 512]) for _ in range(dim)]
    for i in range(n):
        e = hot if i % 3 == 0 else [rng.choice([0.0, -1 / 512, 0.1, -0.3, rng.uniform(-1, 1)]) for _ in range(dim)]
        yield (rng.choice([i, i, i // 2, None]), rng.choice([1, 1, 1, 2, None]), [float(x) for x in e])


def single(rows):
    """As floats of four bytes hold them."""
    import numpy as np

    return [(i, la, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, la, e in rows]


@pytest.mark.parametrize("hot", [False, True])
def test_against_a_loop(spark, monkeypatch, hot):
    if hot:  # the way for tables that are too large to be broadcast
        monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(vector_codes, "HEAVY", 6)
    rows = [*vectors(150, 8, 1), (3, 1, None), (4, 1, [None] * 8), (5, 2, [math.nan] * 8), (6, 2, [math.inf] + [0.0] * 7), (7, 2, [-math.inf] * 8), (8, None, [0.0] * 8)]
    rows = single(rows)
    assert told(spark, rows, parts=4, entries=7) == plain(rows, parts=4, entries=7)


def test_few_vectors_and_none(spark):
    rows = single([*vectors(5, 16, 2)])
    assert told(spark, rows) == plain(rows)
    assert told(spark, [(1, 1, None)]) == [] and told(spark, []) == []


def test_refused(spark):
    for rows in ([(1, 1, [0.0] * 16), (2, 1, [0.0] * 32)], [(1, 1, [0.0] * 15)], [(1, 1, [1e30] * 16)]):
        with pytest.raises(ValueError):
            told(spark, rows)


def test_query(spark):
    compare(spark, QUERIES["op11_vector_codes"], ORACLE_SQL["op11_vector_codes"], "/root/testdata/sf0.01")
