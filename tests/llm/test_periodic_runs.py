import hashlib
import random
import re
import zlib

import numpy as np

from allelix.llm import periodic_runs


def plain_runs(w, least=12):
    """Every stretch at every lag, its smallest period by trial."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + 1 + q < n and w[j + 1] == w[j + 1 + q]:
                j += 1
            end = j + q
            if end - i + 1 >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, end - p + 1)) for p in range(1, q)):
                out.add((i, end - i + 1, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 20])
        w = [rng.randrange(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 3) if size else 0):
            at, p = rng.randrange(size), rng.randint(1, 14)
            for i in range(at + p, min(size, at + rng.randint(1, 70))):
                w[i] = w[i - p]
        yield w


def test_runs_are_those_of_all_lags():
    for w in sequences(1500, 1):
        assert periodic_runs.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_lag_counts_are_the_same_on_either_side_of_the_border():
    for w in sequences(200, 2):
        most = len(w) // 2
        want = [sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(1, most + 1)]
        for heavy in (None, 0, 1, 4, 1000):
            if w:
                assert periodic_runs.lag_matches(np.array(w, np.int64), most, heavy)[1:].tolist() == want


def test_long_repeats():
    rng = np.random.default_rng(3)
    ids = np.tile(rng.integers(0, 300, 1500), 4)
    assert periodic_runs.find_runs(ids) == [(0, 6000, 1500)]
    assert periodic_runs.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def plain_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_rows(spark):
    rng = random.Random(4)
    rows = [(None, None), (None, "a " * 20), (5, ""), (5, " \n\t "), (6, "x y " * 15), (7, "a b c\x0b" * 12), (7, "a b c\x0b" * 12), (8, "é\x1cé \x85 " * 9)]
    rows += [(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(0, 120)))) for i in range(100, 220)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, start int, n_runs string")
    got = periodic_runs.digests(df, periodic_runs.repeated).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert any(r.n_runs for r in got if r.doc_id and r.doc_id >= 100)


def test_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "go " + "la di " * 8 + "end"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs.runs(df).collect()] == [(1, 1, 16, 2)]
    assert {r.doc_id: r.text for r in periodic_runs.collapse(df).collect()} == {1: "go la di end", 2: "nothing here", 3: ""}
    assert periodic_runs.digests(df.where("false")).count() == 0


def test_query_on_whole_table(spark):
    from allelix.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    short = [d for d in docs if len((d.text or "").split()) < 700]
    assert len(short) > 100
    for d in short:
        assert got[d.doc_id] == plain_row(d.doc_id, d.text)
