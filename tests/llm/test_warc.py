import base64
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from allelix.llm import warc

ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, "http://c/", "<p>two</p>\r\n\r\nWARC/1.1"), (3, "http://c/", "<p>two</p>\r\n\r\nWARC/1.1"), (4, None, None), (5, "", ""), (None, "x\ny", "<p>one</p>"),
    (6, "http://d/", "é" * 100_000), (7, "http://e/", "é" * 100_000), (8, "http://f/", "only\n"), (None, None, "n"), (None, None, "n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, row long, sha256 string").repartition(3)


def check(got, rows, min_bytes=0):
    assert len(got) == len(rows)
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        want[i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got) == want
    for digest, n in Counter(r.payload_digest for r in got).items():
        group = [r for r in got if r.payload_digest == digest]
        answers = [r for r in group if r.record_type == "response"]
        if group[0].payload_bytes < min_bytes:
            assert len(answers) == n
            continue
        assert len(answers) == 1 and answers[0].page_id == max((r.page_id for r in group), key=lambda i: (i is not None, i))
        assert all(r.refers_to == answers[0].page_id for r in group if r.record_type == "revisit") and answers[0].refers_to is None
    assert all(r.whole for r in got)


def test_records_with_repeats(spark):
    check(warc.archive(frame(spark, ROWS)).collect(), ROWS)
    check(warc.archive(frame(spark, ROWS), min_bytes=5).collect(), ROWS, 5)


def test_original_records_are_rebuilt_from_headers_and_payloads(spark, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(frame(spark, ROWS), path, file_bytes=1 << 16, records_per_file=100)
    got = warc.rebuilt(spark, path).collect()
    assert Counter((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == Counter((i, u, h or "") for i, u, h in ROWS)
    stored = {r.row: r.header for r in spark.read.parquet(f"{path}/headers").collect()}
    read = warc.read_archive(spark, path, payloads=True).collect()
    assert {r.row: r.header for r in read} == stored == {r.row: r.header for r in got}
    assert sorted(len(r.payload) for r in read if r.payload) == sorted(len(set_) for set_ in {(h or "").encode() for _, _, h in ROWS if h})
    assert all(r.url == ("x%0Ay" if r.page_id is None and r.sha256 == hashlib.sha256(b"<p>one</p>").hexdigest() else r.url) for r in read)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    path = f"{tmp_path}/archive"
    rows = [(i, None, hashlib.sha256(str(i).encode()).hexdigest() * (60 if i % 10 == 0 else 1)) for i in range(200)]
    warc.write_archive(frame(spark, rows), path, file_bytes=8192, records_per_file=64)
    files = spark.read.format("binaryFile").load([f"{path}/warc", f"{path}/warc-large"]).select(F.expr("content")).collect()
    import gzip

    payload = [sum(len(p) for _, p in warc.parse(gzip.decompress(f.content))) for f in files]
    assert sum(payload) == sum(len(h) for _, _, h in rows) and max(payload) <= 8192 and len(warc.rebuilt(spark, path).collect()) == 200


def test_empty_table(spark):
    assert warc.archive(frame(spark, ROWS).limit(0)).collect() == []
