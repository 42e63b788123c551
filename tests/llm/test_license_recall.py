import re

from allelix.llm import license_scan

LINES = {
    "gpl-licensed-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved-line": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
}


def test_every_license_line_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(LINES.values())], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(own)
    words = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", (t or "").lower()) if w) + " "
    want = {(r.doc_id, n) for r in docs.collect() for n, line in LINES.items() if words(line) in words(r.text)}
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    assert got == want and len(want) > len(LINES)
