"""Every stage of the corpus pipeline against plain Python, on tables with shared and null ids, repeated rows and odd texts."""

import random
import struct
import zlib
from collections import Counter

import regex
from tokenizers import Tokenizer

import corpus_pipeline as P
from allelix.llm import near_dedup, packing
from allelix.llm.common import numbered
from allelix.llm.exact_dedup import ExactDedup
from allelix.llm.queries import vocabulary

from .test_small import water_fill

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, size long"
key = lambda r: tuple(map(str, (r[0], r[1], r[3])))


def table(spark, seed=1, n=140):
    rng = random.Random(seed)
    words = {"en": "the cat dog house with from over under water stone green field".split(), "de": "der Hund Katze Haus mit von über unter Wasser Stein grün Feld".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = [rng.choice(words[lang]) + rng.choice(["", "s", "n", str(rng.randrange(40))]) for _ in range(rng.randint(12, 90))]
        rows.append((i, " ".join(text), lang, rng.choice(["a", "b", None])))
        if rng.random() < 0.3:  # near copies, some under the same or no id
            at = rng.randrange(len(text))
            rows.append((rng.choice([i, i + 1000, None]), " ".join([*text[:at], "changed", *text[at + 1 :]]), lang, rng.choice(["a", "b"])))
        if rng.random() < 0.3:
            rows += [(rng.choice([i, i + 2000, None]), rows[-1][1], lang, rng.choice(["a", "c"]))] * rng.randint(1, 2)
    rows += [(1, None, "en", "a"), (None, None, None, None), (2, "", "en", "b"), (3, " \n", "de", "b"), (4, "12 ½ !!", "en", "c"), (5, "!!", "en", "a"), (5, "!!", "en", "a")]
    return rows, spark.createDataFrame([(*r, None, "d", 7, 9) for r in rows], SCHEMA).repartition(3)


def plain(df):
    return [tuple(r[:4]) for r in df.collect()]


def test_language_stage(spark):
    rows, df = table(spark)
    got = plain(P.language_id(spark, df, ""))
    assert Counter(map(key, got)) == Counter(key(r) for r in rows if r[1] and regex.search(r"\p{L}", r[1]))


def test_language_stage_keeps_columns_of_the_models_names(spark):
    df = table(spark)[1].selectExpr("*", "'MINE' AS lang_pred", "9.0D AS score")
    got = P.language_id(spark, df, "")
    assert got.columns == df.columns and {(r.lang_pred, r.score) for r in got.collect()} == {("MINE", 9.0)}


def test_exact_stage(spark):
    rows, df = table(spark)
    out = P.exact(spark, df, "")
    got = plain(out)
    assert out.columns == df.columns
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r)
    assert sorted(r[1] or "" for r in got) == sorted(groups)
    for r in got:
        assert r[0] == max((x[0] for x in groups[r[1] or ""]), key=lambda i: (i is not None, i)) and r in groups[r[1] or ""]


def test_near_stage(spark):
    rows, df = table(spark)
    got = Counter(map(key, plain(P.near(spark, df, ""))))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] and rows[j][1] and near_dedup.similar(rows[i][1], rows[j][1], 0.8):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    groups = {}
    for r, c in zip(rows, root, strict=True):
        groups.setdefault(c, []).append(r)
    assert sum(got.values()) == len(groups)
    for group in groups.values():
        least = min((r[0] for r in group), key=lambda i: (i is None, i))
        assert sum(got[key(r)] > 0 and r[0] == least for r in group)


def test_mixing_stage(spark):
    rows, df = table(spark)
    got = plain(P.mix(spark, df, ""))
    size = lambda t: len((t or "").split())
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    for r in got:
        taken[r[3]] += size(r[1])
    want = water_fill(sizes, dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True)))
    assert all(abs(taken[s] - want[s]) <= 90 for s in want)
    given = Counter(map(key, rows))
    assert all(n <= 3 * given[k] for k, n in Counter(map(key, got)).items()) and all(size(r[1]) for r in got)


def test_packing_stage(spark):
    rows, df = table(spark)
    tokenizer, want = Tokenizer.from_file(vocabulary()), Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for i, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[r[0], i, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))] += 1
    assert Counter(tuple(r[:5]) for r in P.pack(spark, df, "").collect()) == want


def test_whole_run(spark, tmp_path):
    rows, df = table(spark, 2)  # with ids of their own: of rows that share an id, which one stays depends on the order of the rows
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    df = spark.createDataFrame([(*r, None, "d", 7, 9) for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    docs = df
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert Counter(r.ids_crc32 for r in got) == Counter(r.ids_crc32 for r in P.pack(spark, docs, "").collect()) and len(got) > 20
    kept = plain(docs)
    assert {r[1] for r in kept} <= {r[1] for r in rows if r[1] and regex.search(r"\p{L}", r[1])}


def test_empty_table(spark):
    _, df = table(spark)
    docs = df.limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_rows_of_files_are_numbered_without_a_copy(spark, tmp_path):
    _, df = table(spark)
    path = f"{tmp_path}/documents.parquet"
    df.write.parquet(path)
    docs = spark.read.parquet(path)
    rows = numbered(docs)
    first = {(r["__row"], *r[:4]) for r in rows.collect()}
    assert len(first) == docs.count() and {(r["__row"], *r[:4]) for r in rows.repartition(5).collect()} == first
    assert all("numbered-" not in f for f in rows.inputFiles())
    store = ExactDedup(spark, row_col="__row").ingest(rows)
    assert not store._exists("content") and store.result().count() == len(first)
    twice = numbered(docs.union(docs))
    assert twice.select("__row").distinct().count() == 2 * len(first)
    assert len(plain(P.exact(spark, docs, ""))) == len(plain(P.exact(spark, docs.repartition(2), "")))
