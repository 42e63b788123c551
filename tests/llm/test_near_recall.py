"""Recall of the near-duplicate search against all pairs, its alignment against plain edit distance, and odd tables."""

import random

import pytest

from allelix.llm import near_dedup as N


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i, r = rng.randrange(len(words)), rng.random()
        if r < 0.6:
            words[i] = f"n{rng.random()}"
        elif r < 0.8:
            words.insert(i, f"n{rng.random()}")
        elif len(words) > 1:
            del words[i]
    return words


def test_banded_distance_is_the_edit_distance_within_the_band():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 30))] if rng.random() < 0.5 else edited(rng, a, rng.randint(0, 6)) if a else a
        d, band = plain(a, b), rng.randint(0, 30)
        assert N.banded_distance(a, b, band) == (d if d <= band else band + 1) or d > band and N.banded_distance(a, b, band) > band


def test_distances_to_many_are_edit_distances():
    rng = random.Random(6)
    one = [rng.randrange(6) for _ in range(25)]
    many = [edited(rng, one, rng.randint(0, 12)) if rng.random() < 0.7 else [rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(300)]
    many = [[x if isinstance(x, int) else 7 for x in m] for m in many]
    table = N.np.full((len(many), max(map(len, many))), -1)
    for r, m in zip(table, many, strict=True):
        r[: len(m)] = m
    want = [plain(one, m) for m in many]
    for band in (0, 1, 3, 8, 30, 60):
        got = N.distances_to(N.np.array(one), table, N.np.array([len(m) for m in many]), band).tolist()
        assert all(g == w if w <= band else g > band for g, w in zip(got, want, strict=True)), band


@pytest.mark.parametrize("length", [5, 8, 10, 15, 20, 30, 46, 200, 800])
def test_recall_by_length_and_band_of_similarity(spark, length):
    rng = random.Random(7)
    texts, pairs = [], []
    for n in range(200):
        a = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        b = edited(rng, a, 1 + n * max(1, int(length * 0.26)) // 200)
        sim = 1 - N.banded_distance(a, b, len(a) + len(b)) / max(len(a), len(b))
        texts += [" ".join(a), " ".join(b)]
        pairs.append((len(texts) - 2, sim))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in N.near_groups(rows).collect()}
    bands = {}
    for i, sim in pairs:
        if sim >= 0.8 - 1e-9:
            bands.setdefault(min(3, int((sim - 0.8 + 1e-9) / 0.05)), []).append(of[i] == of[i + 1])
        else:
            assert of[i] != of[i + 1]
    assert bands
    for band, hits in bands.items():
        assert len(hits) < 10 or sum(hits) / len(hits) >= 0.9, (length, band, sum(hits) / len(hits))


def test_all_links_against_all_pairs_on_text_of_few_words(spark):
    """Texts that share words, lines and a passage, so that buckets hold dissimilar texts too."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        base = own[:10] + passage + own[10:] if rng.random() < 0.5 else own
        texts.append(base)
        if rng.random() < 0.6:
            texts.append(edited(rng, base, max(1, int(len(base) * rng.uniform(0.01, 0.14)))))
    joined = [" ".join(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if N.similar(joined[i], joined[j], 0.8):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.component_id for r in N.near_groups(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == root


@pytest.mark.parametrize("together", [1, 64])
def test_links_within_a_bucket_of_dissimilar_texts(spark, monkeypatch, together):
    """Texts that share most of their words but aren't similar, so that many of them fail with their bucket's leader and meet each other."""
    monkeypatch.setattr(N, "TOGETHER", together)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(100)]
    texts = []
    for i in range(45):
        texts.append([*passage, *(f"o{i}-{j}" for j in range(42))])
        if i % 3 == 0:
            texts.append(edited(rng, texts[-1], 20))
    joined = [" ".join(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if N.similar(joined[i], joined[j], 0.8):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.component_id for r in N.near_groups(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) < len(texts)


def test_shared_and_null_ids_repeated_rows_and_odd_texts(spark):
    base = [f"w{i}" for i in range(100)]
    a, b, c = " ".join(base), " ".join([*base[:50], "x", *base[51:]]), " ".join(f"q{i}" for i in range(80))
    rows = [(1, a), (1, a), (1, c), (2, b), (None, b), (None, None), (3, ""), (3, " \t"), (4, "one"), (5, "one"), (6, "a b"), (7, " ".join(base * 500)), (8, " ")]
    df = spark.createDataFrame([(i, d, t, "x") for i, (d, t) in enumerate(rows)], "n long, doc_id long, text string, digest string")
    got = {r.row: r for r in N.near_groups(df, row_col="n").collect()}
    assert len(got) == len(rows)
    group = [got[i] for i in (0, 1, 3, 4)]
    assert {g.component_id for g in group} == {1} and {g.group_size for g in group} == {4} and [got[i].kept for i in (0, 1)].count(True) == 1 and not got[3].kept and not got[4].kept
    assert got[2].kept and got[2].group_size == 1 and got[2].component_id == 1
    assert all(got[i].kept and got[i].group_size == 1 for i in (5, 6, 7, 10, 11, 12))
    assert sorted(got[i].kept for i in (8, 9)) == [False, True] and got[9].component_id == 4
    assert sorted(map(str, N.near_groups(df).collect())) == sorted(str(r).rsplit(", row", 1)[0] + ")" for r in got.values())
    assert N.near_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("copies", [2, 300])
def test_only_copies(spark, copies):
    rows = spark.createDataFrame([(i, "the same words in every row of it") for i in range(copies)], "doc_id long, text string")
    got = N.near_groups(rows).collect()
    assert {(r.component_id, r.group_size) for r in got} == {(0, copies)} and [r.doc_id for r in got if r.kept] == [0]
