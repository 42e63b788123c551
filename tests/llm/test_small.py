import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from allelix.llm import exact_dedup, html_extraction, language, license_scan, mixing, near_dedup, packing, sharding
from allelix.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1) for i, t, s in texts], DOCS)


def test_exact_dedup_with_weak_digest_and_repeats(spark):
    rows = [(1, "a", "s"), (2, "b", "s"), (3, "a", "s"), (4, None, "s"), (5, "", "s"), (6, "zz", "s"), (6, "zz", "s")]
    for digest in (exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 0)):
        got = exact_dedup.ExactDedup(spark, digest).ingest(docs(spark, rows)).result().collect()
        by = {(r.doc_id, r.kept): (r.keep_id, r.group_size) for r in got}
        assert len(got) == 7 and by[1, False] == (3, 2) and by[3, True] == (3, 2) and by[4, False] == (5, 2) and by[2, True] == (2, 1)
        assert sorted(r.kept for r in got if r.doc_id == 6) == [False, True]


def water_fill(sizes, weights, cap=3.0):
    out, left, total = {}, dict(weights), float(sum(sizes.values()))
    while left:
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            total -= out[s]
            del left[s]
    return out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), s) for i, s in enumerate(["a"] * 20 + ["b"] * 300 + ["c"] * 150 + [None] * 100)]
    got = mixing.mix(docs(spark, [*rows, (999, None, "b")])).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = water_fill(sizes, dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True)))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    assert len(got) == len(rows) + 1 and all(abs(taken[s] - want[s]) <= 15 for s in want)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(vocabulary())
    for x in ["", "a", " a  b\n\nc ", "it's 12 3½ über\tx", "a   b", "end "]:
        assert [int.from_bytes(encode(x)[i : i + 4], "little") for i in range(0, len(encode(x)), 4)] == t.encode(x, add_special_tokens=False).ids
    got = packing.pack(docs(spark, [(1, "word " * 50, "s"), (2, None, "s"), (3, "long text " * 40, "s"), (3, "long text " * 40, "s")]), vocabulary(), 32).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 32
    assert [r.length for r in got if r.doc_id == 2] == [1]


def test_near_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    other = [word() for _ in range(120)]
    got = {r.doc_id: r for r in near_dedup.near_groups(docs(spark, [(1, " ".join(base), "s"), (2, " ".join(near), "s"), (3, " ".join(other), "s"), (4, None, "s"), (5, " ", "s"), (6, " ".join(base), "s")])).collect()}
    assert {i for i in got if got[i].component_id == 1} == {1, 2, 6} and got[3].kept and got[4].kept and got[5].kept and got[6].group_size == 3


def test_near_groups_of_a_shared_template(spark):
    """Near pairs meet only in buckets led by other texts; against brute force."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(400)]
    texts = []
    for i in range(60):
        a = template[:150] + [f"d{i}x{j}" for j in range(84)] + template[234:]
        texts += [a, a[:160] + [f"e{i}x{j}" for j in range(60)] + a[220:]]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if near_dedup.similar(texts[i], texts[j], 0.8):
                low, high = sorted((want[i], want[j]))
                want = {k: low if c == high else c for k, c in want.items()}
    assert len(set(want.values())) == 60
    got = near_dedup.near_groups(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_html():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<p>three<div class=comments>no</div></article><footer>f</footer>"
    path = max(html_extraction.scores(page), key=lambda x: x[1])[0]
    assert html_extraction.main_text(page, [path]) == "A & B\none two\nthree"
    assert html_extraction.main_text(None, []) == "" and html_extraction.main_text("<p>", []) == ""


def test_language_edges(spark):
    model = language.fit(docs(spark, [(i, "the cat and the dog", "s") for i in range(8)]))
    assert model.predict(None) == ("und", 0.0) and model.predict("123 !") == ("und", 0.0) and model.predict("the")[0] == "en"


def test_licenses(spark):
    text = "x y z " * 30 + license_scan.TEMPLATES["mit-grant"] + " tail " * 20
    got = license_scan.scan(docs(spark, [(1, text, "s"), (2, "Released under the MIT License.", "s"), (3, None, "s"), (4, "a b c d e f g", "s")])).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "mit-grant"), (2, "mit-line")}


def test_shards(spark):
    store = sharding.ShardStore(spark, target_bytes=1 << 20)
    for _ in range(5):
        store.append(docs(spark, [(i, "t", "s") for i in range(10)]).coalesce(1))
    before, version = len(store.shards()), store.compact()
    assert len(store.shards()) < before and store.read(version).count() == 50
    with pytest.raises(FileExistsError):
        store.commit(store.shards(), version - 1)
    store.vacuum()
    assert store.read().count() == 50
