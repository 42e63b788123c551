"""Equal reads are taken through the steps to tags once."""

from allelix.operators import reads as R


def test_equal_reads_are_demultiplexed_once_and_counted(spark):
    seqs = ["ACGTCAGCTTT"] * 5 + ["AAGTCAGCTTT"] * 2 + ["GGTTACTGCAA"] * 3 + ["TTTTTTTTTTT", None, None] + ["ACGTCAGCTNT"]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    keys = spark.createDataFrame([("ACGT", "a"), ("GGTTA", "b")], "barcode string, taxon string")
    plain = R.tags(R.demultiplex(reads, keys, ["CAGC", "CTGC"], 1), ["CAGC", "CTGC"])
    once = R.demultiplex(R.counted(reads), keys, ["CAGC", "CTGC"], 1)
    assert once.count() == 4 and once.columns == ["seq", "n", "barcode", "taxon"]
    t = R.tags(once, ["CAGC", "CTGC"])
    told = lambda d: sorted(map(tuple, d.collect()))
    assert told(R.tag_counts(t, 3)) == told(R.tag_counts(plain, 3)) and sum(r[2] for r in told(R.tag_counts(t))) == 10
    assert told(R.tags_by_taxa(t)) == told(R.tags_by_taxa(plain))
