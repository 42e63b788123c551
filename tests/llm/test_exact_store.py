from collections import Counter

import pytest
from pyspark.sql import functions as F

from allelix.llm import exact_dedup
from allelix.llm.exact_dedup import ExactDedup

weak = lambda t: F.substring(F.sha2(t, 256), 1, 0)


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((i is not None, i or 0, n))
    out = {}
    for t, g in groups.items():
        for known, i, n in g:
            out[n] = (max(g)[1] if max(g)[0] else None, len(g), n == max(g)[2])
    return out


ROWS = [(1, "a"), (2, "b"), (3, "a"), (None, "a"), (4, None), (5, ""), (6, "zz"), (6, "zz"), (None, "n"), (None, "n"), (9, "b"), (7, "é" * 70_000), (8, "é" * 70_000), (8, "c")]


def frame(spark, rows, start=0):
    return spark.createDataFrame([(start + n, i, t, "x", 1) for n, (i, t) in enumerate(rows)], "n long, doc_id long, text string, digest string, file long").coalesce(1)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_a_store_is_reopened_and_goes_on(spark, tmp_path, digest):
    root = f"{tmp_path}/store"
    ExactDedup(spark, digest, root=root, row_col="n").ingest(frame(spark, ROWS[:7]))
    path = f"{tmp_path}/docs.parquet"
    frame(spark, ROWS[7:], 7).write.parquet(path)
    got = ExactDedup(spark, digest, root=root, row_col="n").ingest(spark.read.parquet(path)).result().collect()
    assert {r.row: (r.keep_id, r.group_size, r.kept) for r in got} == brute(ROWS)
    again = ExactDedup(spark, digest, root=root, row_col="n").result().collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert ExactDedup(spark, digest, root=root).ingest(frame(spark, [])).result().count() == len(ROWS)


def test_the_locators_are_read(spark, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    frame(spark, [(1, "a"), (2, "a"), (3, "b")]).write.parquet(path)
    store = ExactDedup(spark, root=f"{tmp_path}/store").ingest(spark.read.parquet(path))
    state = {r.n: r.keep for r in store.state().collect()}
    assert state[2].doc_id == 2 and state[2].row == 1 and state[2].file.endswith(".parquet")
    frame(spark, [(1, "a"), (2, "changed"), (3, "b")]).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="differ|weren't found|does not exist"):
        store.result()


def test_computed_texts_are_kept_in_the_store(spark, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    frame(spark, [(1, "a"), (2, "A"), (3, "b")]).write.parquet(path)
    lower = spark.read.parquet(path).withColumn("text", F.lower("text"))
    got = ExactDedup(spark, from_files=False).ingest(lower).result().collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 2, False), (2, 2, True), (3, 3, True)}


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []
