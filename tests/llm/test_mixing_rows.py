import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from allelix.llm import mixing

from .test_small import docs, water_fill


def test_repeated_rows_and_null_ids_are_rounded_one_by_one(spark):
    rows = [(7, "w " * 5, "a")] * 2500 + [(None, "w " * 3, "b")] * 40 + [(i, "w " * (i % 9), "c") for i in range(300)] + [(1, None, None), (2, " \t", None), (3, "x", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water_fill(sizes, dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True)))
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 9 for s in want)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_rows_by_number(spark):
    df = docs(spark, [(1, "a b c", "s")] * 50 + [(1, "x", "t")]).withColumn("n", F.monotonically_increasing_id())
    got = mixing.mix(df, row_col="n").collect()
    assert sorted(r.row for r in got) == sorted(r.n for r in df.collect())


def test_targets_of_many_sources_against_water_filling(spark):
    rng = random.Random(4)
    names = [*(f"s{i:03d}" for i in range(200)), "é", "Z", None]
    sizes = {n: rng.choice([0, 1, 5, 1000, rng.randint(1, 100_000)]) for n in names}
    ordered = [*sorted(n for n in names if n is not None), None]
    want = water_fill(sizes, {n: (5, 2, 1)[i % 3] for i, n in enumerate(ordered)})
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert len(got) == len(names)
    for r in got:
        assert r.target == pytest.approx(want[r.source], abs=1e-6)


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [(1, "a", "s")]).limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None)])).collect()] == [0]
