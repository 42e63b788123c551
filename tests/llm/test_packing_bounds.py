import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from allelix.llm import packing
from allelix.llm.queries import vocabulary


def least(lengths, capacity):
    """The fewest sequences, by exhaustive search."""
    lengths = sorted(lengths, reverse=True)

    def fits(bins, at, rooms):
        if at == len(lengths):
            return True
        for r in set(rooms):
            if r >= lengths[at]:
                left = list(rooms)
                left[left.index(r)] = r - lengths[at]
                if fits(bins, at + 1, tuple(left)):
                    return True
        return False

    return next(n for n in itertools.count(-(-sum(lengths) // capacity)) if fits(n, 0, (capacity,) * n))


def test_the_reduction_keeps_a_best_packing():
    rng = random.Random(1)
    kinds = Counter()
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        lengths = [rng.randint(max(1, capacity // 6), capacity) for _ in range(rng.randint(1, 11))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        fixed = packing.reduce_instance(counts, capacity)
        used = Counter()
        for p, times in fixed:
            assert sum(p) <= capacity and times > 0
            kinds[len(p)] += times
            for w in p:
                used[w] += times
        left = [w for w in range(capacity + 1) for _ in range(counts[w])]
        assert Counter(lengths) == used + Counter(left)
        assert sum(t for _, t in fixed) + (least(left, capacity) if left else 0) == least(lengths, capacity), lengths
    assert kinds[1] and kinds[2] and kinds[3]


def test_many_copies_are_fixed_at_once():
    counts = np.zeros(101, np.int64)
    counts[[90, 60, 40, 10, 7]] = [10**9, 10**9, 10**9, 10**9, 5]
    fixed = packing.reduce_instance(counts, 100)
    assert len(fixed) < 100 and sum(t for _, t in fixed) >= 2 * 10**9


@pytest.mark.parametrize("seed", range(3))
def test_sequences_against_the_lower_bound(seed):
    rng = random.Random(seed)
    lengths = [min(1024, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20_000)]
    n = sum(t for _, t in packing.patterns(Counter(lengths), 1024))
    bound = -(-sum(lengths) // 1024)
    assert bound <= n <= bound * 1.005 + 1


def test_pieces_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(5, "a\x1cb"), (5, None), (5, None), (None, "x" * 9000), (10**9, "tab\t end \n\n two  spaces 　x\r\n"), (10**9 + 1, "word " * 3000), (10**9 + 2, "<|endoftext|> a<|endoftext|>\n"), (10**9 + 3, "漢字" * 900)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = packing.pack(docs, vocabulary()).collect()
    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        for i, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[r.doc_id, i, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in rows.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(rows) <= -(-sum(r.length for r in got) // 1024) * 1.02 + 1


def test_repeated_rows_are_spread_over_buckets(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3000 + [(None, "a b c")] * 10, "doc_id long, text string")
    got = packing.pack(docs, vocabulary(), 64, bucket_rows=100).collect()
    assert len(got) == 3010 and len({(r.sequence_id, r.offset) for r in got}) == 3010
    assert packing.pack(docs.limit(0), vocabulary()).collect() == []
