import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from allelix.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["the", "naïve", "über", "3½", "it's", "WE'LL", "<|endoftext|>", "<|endoftext", "日本語", " ", "  ", "\n\n", "\t", "\x1c", "\x85", "a.b,c", "!!!", "é", "𝔘", "😀", "​", "²", "Ⅷ", "_x_", "\r\n", "0123456789", "antidisestablishmentarianism", "　"]


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(WORDS) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 30)))


def test_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(texts(600, 1))]
    rows += [(None, None), (None, "a"), (7, ""), (7, "a"), (8, " " * 5000), (9, "word " * 30000), (10, "x" * 3000), (11, "<|endoftext|><|endoftext|> ")]
    got = token_counts.count_tokens(spark.createDataFrame([(i, t, 5, "y") for i, t in rows], "doc_id int, text string, n_tokens int, n_bytes string"), PATH).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_slices_change_nothing(monkeypatch):
    library = Tokenizer.from_file(PATH)
    of = token_counts.vocabulary_of(PATH)
    proven = frozenset(t for t in of.strings() if of.merged(t) == 1)
    monkeypatch.setattr(token_counts, "SLICE", 5)
    count = token_counts.Counter(PATH, proven)
    for t in texts(400, 2):
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_proofs_hold_for_other_vocabularies(spark):
    """With and without the shortcut the counts are those of the library, for a file with a normalizer too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    whole = {r.token for r in token_counts.proofs(spark, path).where("whole").collect()}
    assert 0 < len(whole) < library.get_vocab_size(False)
    for proven in (frozenset(whole), frozenset()):
        count = token_counts.Counter(path, proven)
        for t in [*texts(200, 3), "Straße <|startoftext|>  x", "the cat"]:
            assert count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_a_string_that_is_not_one_token_is_not_proven(spark):
    """Every proven string is one token as the library says, and no other string of the vocabulary is."""
    library = Tokenizer.from_file(PATH)
    for r in token_counts.proofs(spark, PATH).sample(0.02, seed=1).collect():
        assert r.whole == (len(library.model.tokenize(r.token)) == 1)


def test_empty_table_and_other_files(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(ValueError, match="tokenizers"):
        token_counts.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))


def test_query_on_whole_table(spark):
    from allelix.llm.queries import QUERIES

    library = Tokenizer.from_file(PATH)
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert got[d.doc_id] == (d.doc_id, len((d.text or "").encode()), n, n > 512)
