"""What keeps queries within bounds on larger tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.functions import encoding, stats
from allelix.operators import association, donors, joins, pairs, traits, windows
from allelix.sources import alignments, text


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(5)
    rows = [(t, s, *r.choice([(0, 0), (1, 1), (0, 1), (15, 15)])) for t in range(30) for s in range(200) if r.random() < 0.8]
    return spark.createDataFrame(rows, "taxon_id int, site_id int, a1 int, a2 int")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("f", [pairs.ibs, pairs.kinship, pairs.haplotype_distance])
def test_pairs_are_summed_in_their_tile(calls, f, monkeypatch):
    """Several tiles and chunks give what one gives; above the tiles nothing is grouped or joined by pair."""
    monkeypatch.setattr(pairs, "LEAST_TAXA", 1 << 20)
    one = f(calls)
    want = {tuple(r)[:2]: tuple(r)[2:] for r in one.collect()}
    for k, v in {"LEAST_TAXA": 1, "TILE_TAXA": 7, "PAIRS_AT_ONCE": 16, "SITES_AT_ONCE": 64, "WORDS_AT_ONCE": 1}.items():
        monkeypatch.setattr(pairs, k, v)
    many = f(calls)
    above = _plan(many).split("MapInPandas")[0]
    assert "Aggregate" not in above
    got = {tuple(r)[:2]: tuple(r)[2:] for r in many.collect()}
    assert len(want) >= 435 and got.keys() == want.keys()
    assert all(g == pytest.approx(w, abs=1e-9) for g, w in ((got[k], want[k]) for k in want))


def test_tiles_are_bounded_by_taxa():
    assert pairs.tiles_of(100, 200) == 2 and pairs.tiles_of(60_000, 4) == 30
    assert pairs.tiles_of(0, 4) == 1


def test_diversity_of_many_taxa(spark):
    """The squares of 60,000 and more don't fit an int."""
    stats = spark.createDataFrame([(70_000.0, 10, 3, 1.5)], "n double, sites long, seg long, pi double")
    row = windows.diversity(stats).first()
    assert row["a2"] == pytest.approx(math.pi**2 / 6 - 1 / 70_000, abs=1e-9) and row["tajima_d"] is not None


def test_formats_are_guessed_by_the_first_file(spark, tmp_path):
    """Spark reads the largest file of a folder first."""
    (tmp_path / "part-00000.txt").write_text("##fileformat=VCFv4.0\n")
    (tmp_path / "part-00001.txt").write_text("1\t5\ts\tA\tC\t.\tPASS\t.\tGT\t0/0\n" * 50)
    assert text.guess(str(tmp_path), spark) == "vcf"


def test_lines_are_split_once_a_line(spark, tmp_path):
    """Names of different lengths in the header; nothing above the generator splits the whole line."""
    names = ["a", "bbb", "cc"]
    (tmp_path / "x.hmp.txt").write_text("\t".join([*text.HAPMAP, *names]) + "\n" + "\t".join(["s", "A/C", "1", "5", "+", *["NA"] * 6, "AC", "CC", "NN"]) + "\n")
    df = text.read_hapmap(spark, str(tmp_path / "x.hmp.txt"))
    assert [tuple(r) for r in df.collect()] == [("a", "s", "1", 5, 0, 1), ("bbb", "s", "1", 5, 1, 1), ("cc", "s", "1", 5, 15, 15)]
    assert "split(value" not in _plan(df).split("Generate")[0] and "lambda" not in _plan(df)


def test_estimates_keep_a_cell_a_row(spark):
    """A trait's rows are summed up before its task; rows that repeat weigh as rows."""
    rows = [(t, "y", float(t + (e == "b") * 2 + k), e) for t in range(4) for e in "ab" for k in range(t + 3 if e == "a" else 2)]
    v = spark.createDataFrame(rows, "taxon_id int, trait string, value double, env string")
    got = association.estimates_by_taxon(v, ["env"])
    x = np.array([[*(t == i for i in range(4)), e == "b"] for t, _, _, e in rows], float)
    b = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0]
    told = got.orderBy("taxon_id").collect()
    assert [r["blue"] for r in told] == pytest.approx(b[:4] + b[4] / 2) and [r["n"] for r in told] == [t + 5 for t in range(4)]
    assert _plan(got).count("Aggregate") == 1


def test_nearest_taxa_come_from_every_tile(spark, monkeypatch):
    r = random.Random(3)
    rows = [(t, k, None if r.random() < 0.3 else float(r.randint(0, 9))) for t in range(40) for k in ("x", "y", "z")]
    v = spark.createDataFrame(rows, "taxon_id int, trait string, value double")
    own = {t: {k: x for u, k, x in rows if u == t and x is not None} for t in range(40)}
    want = {}
    for t, k, x in rows:
        near = sorted((sum(abs(own[t][m] - own[u][m]) for m in own[t].keys() & own[u]) / len(own[t].keys() & own[u]), u) for u in own if u != t and k in own[u] and own[t].keys() & own[u])[:3]
        want[t, k] = x if x is not None else sum(own[u][k] for _, u in near) / len(near) if near else None
    for k, x in {"LEAST_TAXA": 1, "TILE_TAXA": 7}.items():
        monkeypatch.setattr(pairs, k, x)
    got = {(a["taxon_id"], a["trait"]): a["value"] for a in traits.knn_impute(v, 3).collect()}
    assert got == {k: x if x is None else pytest.approx(x) for k, x in want.items()}


def test_synonyms_come_from_every_tile(spark, monkeypatch):
    """The best by pair_similarity over all pairs, without a join by letter pair."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcA ") for _ in range(r.randint(1, 7)))
    a, b = ([(word(),) for _ in range(60)] for _ in range(2))
    a, b = spark.createDataFrame(a, "taxon string"), spark.createDataFrame(b, "taxon string")
    every = a.distinct().select(F.col("taxon").alias("name")).crossJoin(b.distinct().select(F.col("taxon").alias("known")))
    every = every.select("name", "known", encoding.pair_similarity("name", "known").alias("score")).where("score > 0")
    want = {}
    for row in sorted(every.collect(), key=lambda r: (-r["score"], r["known"])):
        want.setdefault(row["name"], (row["score"], row["known"]))
    for k, x in {"LEAST_TAXA": 1, "TILE_TAXA": 7}.items():
        monkeypatch.setattr(pairs, k, x)
    got = joins.synonyms(a, b)
    assert "Join" not in _plan(got)
    assert {r["name"]: (r["score"], r["known"]) for r in got.collect()} == want


def test_presence_counts_meet_in_buckets(spark):
    word = "array<struct<word: int, mj: long, mn: long>>"
    t = spark.createDataFrame([(i, 1, 0, [(0, i, 7), (1, 3, i)]) for i in range(9)], f"taxon_id int, chrom int, block int, words {word}")
    d = spark.createDataFrame([(i, 1, 0, [(0, 5, i)]) for i in range(4)], f"donor int, chrom int, block int, words {word}")
    one, many = (donors.presence_counts(t, d, n) for n in (100, 2))
    assert "bucket" in _plan(many) and sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and many.count() == 36


def test_exact_test_leaves_out_what_is_zero(monkeypatch):
    """As many probabilities as doubles can tell from 0, which grow with the root of the counts."""
    asked = []
    monkeypatch.setattr(stats, "lgamma", lambda x: asked.append(x) or math.lgamma(x))
    for a, b, c, d in ((20_000, 20_000, 20_000, 20_100), (0, 5, 5, 0), (3, 0, 0, 0), (9_000, 1, 2, 8_000)):
        asked.clear()
        got = stats.fisher(a, b, c, d)
        assert len(asked) < 9 * 16_000
        r, s, k = a + b, c + d, a + c
        ln = lambda n, m: math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
        p = {x: math.exp(ln(r, x) + ln(s, k - x) - ln(r + s, k)) for x in range(max(0, k - s), min(r, k) + 1)}
        want = sum(v for x, v in p.items() if x <= a), sum(v for x, v in p.items() if x >= a), sum(v for v in p.values() if v <= p[a] * (1 + 1e-9))
        assert got == pytest.approx([min(1.0, v) for v in want], rel=1e-6)


def test_sequences_are_packed_without_steps_by_letter(spark):
    seqs = ["ACGT" * 16, "T" * 31, "A" * 40, "C", "", "ACN", None]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("w", encoding.packed_sequence("s")).withColumn("back", encoding.unpacked_sequence("w", F.length("s")))
    assert "aggregate(" not in _plan(df)
    word = lambda x: sum("ACGT".index(b) * 4 ** (len(x) - 1 - i) for i, b in enumerate(x))
    for r in df.collect():
        known = r["s"] and "N" not in r["s"]
        assert r["w"] == ([word(r["s"][i : i + 31]) for i in range(0, len(r["s"]), 31)] if known else None) and r["back"] == (r["s"] if known else None)


def test_fields_of_an_alignment_are_parsed_once(spark, tmp_path):
    (tmp_path / "x.sam").write_text("\t".join(["r", "0", "chr1", "5", "60", "4M1I3M", "*", "0", "0", "ACGTACGT", "*", "MD:Z:2T4"]) + "\n")
    df = alignments.read_sam(spark, str(tmp_path / "x.sam")).select("end", "variants")
    assert _plan(df).count("regexp_extract_all") == 2
    r = df.first()
    assert r["end"] == 11 and [tuple(v) for v in r["variants"]] == [(7, "T", "G"), (8, "-", "A")]
