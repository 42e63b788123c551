from collections import Counter

import pytest
from pyspark.sql import functions as F

from allelix.llm.sharding import ShardStore, shard


def rows(spark, n, start=0):
    return spark.range(start, start + n, 1, 1).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))


def test_one_object_writes_and_another_goes_on(spark, tmp_path):
    root = f"{tmp_path}/store"
    assert ShardStore(spark, root).read().columns == [] and ShardStore(spark, root).compact() == 0
    for k in range(5):
        assert ShardStore(spark, root, 1 << 20).append(rows(spark, 10, 10 * k)) == k + 1
    store = ShardStore(spark, root, 1 << 20)
    assert store.read(3).count() == 30
    version = store.compact()
    assert len(ShardStore(spark, root).shards()) < 5 and version == 6
    assert sorted(r.doc_id for r in ShardStore(spark, root).read().collect()) == list(range(50))
    ShardStore(spark, root).vacuum()
    assert ShardStore(spark, root).read().count() == 50 and ShardStore(spark, root, 1 << 20).append(rows(spark, 1, 99)) == 7


def test_added_columns_stay_and_changed_types_are_refused(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/store", 1 << 20)
    store.append(rows(spark, 4))
    store.append(rows(spark, 4, 4).withColumn("new", F.lit(1)))
    store.append(rows(spark, 4, 8).drop("text"))
    store.append(rows(spark, 4, 12))
    store.compact()
    got = {r.doc_id: (r.text, r.new) for r in ShardStore(spark, store.root).read().collect()}
    assert got[0] == ("t", None) and got[5] == ("t", 1) and got[9] == (None, None) and len(got) == 16
    with pytest.raises(TypeError):
        store.append(rows(spark, 1).withColumn("new", F.lit("x")))


def test_of_two_writers_one_wins_and_lost_runs_block_nothing(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/store")
    store.append(rows(spark, 4))
    store._write(rows(spark, 4))  # a run that was lost before its commit
    with pytest.raises(FileExistsError):
        store.commit([], 0)
    assert store.append(rows(spark, 4, 4)) == 2 and store.read().count() == 8
    store._put("versions/v-000000003", "")  # a claim that was lost before its content
    assert store.version() == 2 and ShardStore(spark, store.root).read().count() == 8
    with pytest.raises(FileExistsError):
        store.append(rows(spark, 4, 8))
    store.vacuum()
    assert store.append(rows(spark, 4, 8)) == 3 and store.read().count() == 12
    files = [n for f in store._fs.listStatus(store._path("data")) for n, _ in store._names("data/" + f.getPath().getName()) if n.endswith(".parquet")]
    assert set(files) == {s["path"] for s in store.shards()}


def test_rows_as_they_are_and_the_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "t" * 100_000, None)], "doc_id long, text string, shard string")
    got = shard(df).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 1, None]) and all(r.shard_bytes > 0 and r.version >= 1 for r in got)
    assert shard(df.limit(0)).collect() == []
