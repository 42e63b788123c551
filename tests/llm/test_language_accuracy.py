import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from allelix.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, score string"


def test_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(told) == len(rows)
    assert all(told[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [(told[r.doc_id].lang_pred, r.lang) for r in rows if told[r.doc_id].held_out and r.lang and told[r.doc_id].lang_pred != "und"]
    assert len(tested) > 150 and sum(a == b for a, b in tested) / len(tested) >= 0.95
    assert all(0 <= r.score <= 1 for r in told.values()) and {r.lang_pred for r in told.values()} <= {"und", *(r.lang for r in rows)}


def test_ids_sources_and_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    changed = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(changed).collect()} == first


def test_texts_without_letters_and_odd_rows(spark):
    words = {"en": "the cat and the dog were here with that thing", "de": "der Hund und die Katze waren nicht hier mit dem", "fr": "le chat et le chien ne sont pas dans cette maison"}
    rows = [(i, f"{words[k]} {i}", k, "s", "x", "y") for i in range(60) for k in [list(words)[i % 3]]]
    odd = ["½", "²", "①", "_", "12 ٣", None, "", " \n", "!?", "𝟘"]
    rows += [(1000 + i, t, "en", "s", "x", "y") for i, t in enumerate(odd)] + [(2000, "the cat and the dog " * 100_000, "en", None, None, None), (None, words["de"], None, None, None, None), (2000, words["fr"], "fr", None, None, None)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id and 1000 <= r.doc_id < 2000)
    assert {(r.doc_id, r.lang_pred) for r in got if not r.doc_id or r.doc_id >= 2000} == {(2000, "en"), (2000, "fr"), (None, "de"), (0, "en")}
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "text", None, "s", "x", "y")], SCHEMA)).collect()} == {"und"}


def test_features_do_not_depend_on_chunks():
    text = "The cat — and the İstanbul dog ß " * 40
    whole = language.features(text)
    for chunk in (1, 2, 3, 7, 100):
        part = language.features(text, chunk)
        assert np.array_equal(whole[0], part[0]) and np.allclose(whole[1], part[1])


def test_family_first_and_ties_by_name():
    eye = np.eye(4, language.DIMS, dtype=np.float32)
    model = language.LanguageModel(np.repeat(eye, 5, axis=0), np.repeat(np.array(["en", "de", "fr", "xx"], object), 5))
    assert model.names == ["germanic", "romance", "xx"] and list(model.within) == ["germanic"]
    for i, code in enumerate(["en", "de", "fr", "xx"]):
        family, _ = model._family(np.array([i]), np.ones(1, np.float32))
        assert model._language(family, np.array([i]), np.ones(1, np.float32))[0] == code
    model.within["germanic"][1][:] = 0
    assert model._language("germanic", np.array([9]), np.ones(1, np.float32)) == ("de", 0.5)
