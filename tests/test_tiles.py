"""Tiles of taxa are written once and read by the tasks that compare them; no copies of them are dealt."""

import random

import pytest

from allelix.functions import tables
from allelix.operators import association, pairs


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(6)
    rows = [(t, s, *r.choice([(0, 0), (1, 1), (0, 1), (15, 15)])) for t in range(40) for s in range(150) if r.random() < 0.8]
    return spark.createDataFrame(rows, "taxon_id int, site_id int, a1 int, a2 int")


def _relationship(calls):
    return association.relationship(calls.where("a1 < 14").selectExpr("taxon_id", "site_id marker", "cast(a1 + a2 as double) value"))


def _traits(calls):
    return pairs.trait_distance(calls.where("a1 < 14").selectExpr("taxon_id", "concat('t', site_id % 5) trait", "cast(a1 as double) value"))


@pytest.mark.parametrize("f", [pairs.ibs, lambda c: pairs.ibs(c, diagonal=True), pairs.kinship, pairs.haplotype_distance, _relationship, _traits])
def test_tiles_are_not_copied(calls, f, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST_TAXA", 1 << 20)
    want = {tuple(r)[:2]: tuple(r)[2:] for r in f(calls).collect()}
    written = {}

    def write(df, name, keep=False):
        out = tables.materialize(df, name, keep)
        written[name] = out.count()
        return out

    monkeypatch.setattr(pairs, "materialize", write)
    for k, v in {"LEAST_TAXA": 1, "TILE_TAXA": 6, "SITES_AT_ONCE": 64, "WORDS_AT_ONCE": 1}.items():
        monkeypatch.setattr(pairs, k, v)
    many = f(calls)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert 7 <= written["tiles"] <= written["pairs"] <= 40 * 4
    got = many.collect()
    assert len(got) == len(want) and {tuple(r)[:2] for r in got} == want.keys()
    assert all(tuple(r)[2:] == pytest.approx(want[tuple(r)[:2]], abs=1e-9) for r in got)


def test_a_tile_has_bounded_rows(calls, monkeypatch):
    """Where an item has many chunks, tiles have fewer items."""
    monkeypatch.setattr(pairs, "LEAST_TAXA", 1 << 20)
    monkeypatch.setattr(pairs, "WORDS_AT_ONCE", 1)
    monkeypatch.setattr(pairs, "TILE_ROWS", 10)
    many = pairs.ibs(calls)
    assert many.count() == 40 * 39 // 2 and many.rdd.getNumPartitions() >= 12 * 12 // 2
