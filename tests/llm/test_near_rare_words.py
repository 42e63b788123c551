"""The last step of the near-duplicate search: texts with a common passage meet by their rare words only, and no similar pair is missed."""

import random

import pytest

from allelix.llm import near_dedup as N


def texts_of(rng, n=240):
    vocabulary, passage = [f"v{i}" for i in range(3000)], [f"p{i}" for i in range(70)]
    texts = []
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(45, 75))]
        texts.append([*own[:20], *passage, *own[20:]])
        if i % 4 == 0:
            t = list(texts[-1])
            for _ in range(rng.randint(1, len(t) // 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block", [16, 2048])
def test_texts_of_a_common_passage_meet_by_rare_words(spark, block):
    texts = texts_of(random.Random(4))
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if N.similar(texts[i], texts[j], 0.8)}
    assert len(similar) > 20
    rows = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    levels = N._levels(rows)
    tokens = [(i, i, len(t.split()), N.rare_words(t.split(), levels, 0.8).tolist()) for i, t in enumerate(texts)]
    tokens = spark.createDataFrame(tokens, "rep long, c long, words int, tokens array<long>")
    met = {(min(r.u, r.v), max(r.u, r.v)) for r in N._near(tokens, rows.select("rep"), 0.8, False, block).collect()}
    assert similar <= met and len(met) < len(texts) * (len(texts) - 1) // 2 // 5


@pytest.mark.parametrize("own", [True, False])
def test_links_of_strays_are_those_of_all_pairs(spark, own):
    """With components of their own, and with texts that are in large components already; only some are strays."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    texts = texts_of(rng, 40)
    for _ in range(50):  # copies of a base that are about as far from each other as may be
        t = list(base)
        for _ in range(rng.randint(6, 13)):
            t[rng.randrange(len(t))] = f"e{rng.random()}"
        texts.append(" ".join(t))
    root = [i if own or i < 50 else 50 + i % 5 for i in range(len(texts))]
    strays = {i for i in range(len(texts)) if i % 3}

    def joined(pairs):
        c = list(root)
        for i, j in pairs:
            low, high = sorted((c[i], c[j]))
            c = [low if x == high else x for x in c]
        return c

    want = joined((i, j) for j in range(len(texts)) for i in range(j) if (i in strays or j in strays) and N.similar(texts[i], texts[j], 0.8))
    rows = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    nodes = spark.createDataFrame([(i, c) for i, c in enumerate(root) if i != c or c >= 50], "node long, component long")
    links = N._rest(spark.createDataFrame([(i,) for i in sorted(strays)], "rep long"), rows, nodes, 0.8).collect()
    assert all(N.similar(texts[r.u], texts[r.v], 0.8) for r in links)
    assert joined((r.u, r.v) for r in links) == want


def test_similar_to_many_is_similar_to_each():
    rng = random.Random(12)
    one = [f"w{i}" for i in range(60)]
    many = []
    for n in range(150):
        t = list(one)
        for _ in range(rng.randint(0, 18)):
            t[rng.randrange(60)] = "x"
        many.append(" ".join(t[: rng.randint(45, 60)] if n % 3 == 0 else t))
    many += ["", " ", "unlike"]
    for others in (many, many[:5]):
        assert N.similar_to(" ".join(one), others, 0.8) == [N.similar(" ".join(one), x, 0.8) for x in others]
    assert N.similar_to("", many, 0.8) == [False] * len(many)
