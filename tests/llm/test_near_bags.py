"""Bags of words: they let no similar pair go, and texts that share a passage and words of a small vocabulary make no pair to align."""

import random

import numpy as np
import pandas as pd

from allelix.llm import near_dedup as N


def bags_of(texts):
    return N._Bags(pd.Series([len(t) for t in texts]), pd.Series([N.word_bag(N.word_hashes(t)) for t in texts]))


def test_bags_let_no_similar_pair_go(monkeypatch):
    monkeypatch.setattr(N, "MOST_BINS", 1 << 11)
    rng = random.Random(4)
    texts = []
    for n in (1, 5, 30, 120, 127, 129, 140, 600, 3000):
        base = [f"w{rng.randrange(n)}" for _ in range(n)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, max(1, n // 4))):
                i, r = rng.randrange(len(t)), rng.random()
                t[i : i + 1] = ["x"] if r < 0.6 else [t[i], f"y{r}"] if r < 0.8 or len(t) == 1 else []
            texts.append(t)
    x, y = (np.array(v) for v in zip(*((i, j) for j in range(len(texts)) for i in range(j)), strict=True))
    got = set(N.alike(bags_of(texts), x, bags_of(texts), y, 0.8, 16).tolist())
    similar = {k for k, (i, j) in enumerate(zip(x, y, strict=True)) if N.similar(" ".join(texts[i]), " ".join(texts[j]), 0.8)}
    assert len(similar) > 100 and similar <= got and len(got) < len(x) // 4


def test_dissimilar_texts_of_shared_buckets_are_not_aligned(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary, passage = [f"v{i}" for i in range(500)], [f"p{i}" for i in range(60)]
    texts = []
    for i in range(160):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(95, 105))]
        texts.append([*own[:20], *passage, *own[20:]])
        if i % 8 == 0:
            t = list(texts[-1])
            for _ in range(rng.randint(1, 28)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(t)
    joined, root = [" ".join(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if N.similar(joined[i], joined[j], 0.8):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    aligned = []
    for name in ("_verified", "_aligned"):
        was = getattr(N, name)
        monkeypatch.setattr(N, name, lambda pairs, *rest, was=was: aligned.append(pairs.count()) or was(pairs, *rest))
    got = {r.doc_id: r.component_id for r in N.near_groups(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) < len(texts) - 10
    assert sum(aligned) < 100
