import pytest

from allelix.llm import html_extraction


@pytest.mark.parametrize("sizes", [[500] * 5, [5000, 300]])
def test_repeated_children_do_not_beat_the_article(spark, sizes):
    parts = "".join(f"<section><p>{'x' * n}</p></section>" for n in sizes)
    page = f"<html><body><article><h1>Heading</h1><p>{'i' * 400}</p>{parts}</article></body></html>"
    rows = spark.createDataFrame([(i, f"http://a.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    want = "\n".join(["Heading", "i" * 400, *("x" * n for n in sizes)])
    assert [r.text for r in html_extraction.extract(rows).collect()] == [want] * 3
