"""Token counts with a shortcut for whole tokens.

A byte-pair tokenizer cuts a text into pre-tokens and merges the letters of each by itself. Before any text is read, a job over
the vocabulary merges every string of it and keeps those that end as one token (`proofs`); it isn't taken for granted that a
string of the vocabulary does. A pre-token that is one of them counts as one token without a merge; only the rest go through
the merges, each one once a worker as long as the memory of MERGED entries lasts. Nothing is shuffled: the proven strings, bounded by the vocabulary,
are broadcast, and each text is read where it lies.

Pre-tokens are cut by the file's own pre-tokenizer. For the common byte-level one, ASCII texts are cut by the same rule as a
regular expression, and other texts space by space, so that only words with other letters go to the library.
Long texts are cut at single spaces between other characters, which no pre-token reaches over, so memory is bounded
by SLICE characters and not by the text. Texts with added tokens such as <|endoftext|> are cut at them first, each counts one,
which is the library's default. Files with a normalizer, or with added tokens that take the white space beside them, are
counted by the library's own cut, text by text, with the same shortcut or, if such a token occurs, whole.

Defined results: a null text is empty and has no tokens; repeated rows, those with equal or null ids too, are counted each by
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

SLICE = 1 << 20
MERGED = 500_000
#: The byte-level pre-tokenizer's pattern for ASCII texts.
ASCII_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+").findall
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s").findall
#: Control characters that Python's \s takes for white space and the library doesn't.
ODD = re.compile(r"[\x1c-\x1f]")
BORDER = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The letter by which the byte-level form writes each byte: itself if it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = byte_letters()


class Vocabulary:
    """A tokenizer file of the `tokenizers` library: its strings, its cut and its merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        if not path.endswith(".json"):
            raise ValueError(f"{path} isn't a file of the tokenizers library")
        self.raw = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        added = [t for t in said.get("added_tokens") or []]
        cut = said.get("pre_tokenizer") or {}
        self.plain = said.get("normalizer") is None and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        self.byte_level = self.plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        if not cut:
            raise ValueError(f"{path} has no pre-tokenizer, so texts have no parts that are merged by themselves")

    def merged(self, letters: str) -> int:
        return len(self.raw.model.tokenize(letters))

    def strings(self) -> list[str]:
        return sorted(self.raw.get_vocab(with_added_tokens=False))

    def pretokens(self, text: str) -> list[str]:
        """In the form that is merged."""
        text = text if self.raw.normalizer is None else self.raw.normalizer.normalize_str(text)
        return [p for p, _ in self.raw.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(4)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """token, whole: each string of the vocabulary, and whether it alone is merged to one token."""

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = vocabulary_of(path)
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "whole": [of.merged(t) == 1 for t in b["token"]]})

    strings = spark.createDataFrame([(t,) for t in vocabulary_of(path).strings()], "token string")
    return strings.mapInPandas(prove, "token string, whole boolean")


class Counter:
    """Counts the tokens of texts; proven: the strings that are one token."""

    def __init__(self, path: str, proven: frozenset[str]):
        self.of = vocabulary_of(path)
        self.proven = set(proven)
        self.table = {b: LETTERS[b] for b in range(128)}
        if self.of.byte_level:  # ASCII pre-tokens are looked up as they stand in the text
            back = {ord(letter): chr(b) for b, letter in LETTERS.items() if b < 128}
            ascii_letters = set(back)
            self.proven |= {t.translate(back) for t in proven if ascii_letters.issuperset(map(ord, t))}
        self.rest: dict[str, int] = {}
        self.cuts: dict[str, list[str]] = {}

    def _merged(self, part: str) -> int:
        n = self.rest.get(part)
        if n is None:
            n = self.of.merged(part.translate(self.table) if self.of.byte_level and part.isascii() else part)
            if len(self.rest) < MERGED and len(part) < 40:
                self.rest[part] = n
        return n

    def _pretokens(self, text: str) -> list[str]:
        if not self.of.byte_level or ODD.search(text):
            return self.of.pretokens(text)
        if text.isascii():
            return ASCII_CUT(text)
        found: list[str] = []
        for chunk in CHUNKS(text):
            if chunk.isascii():
                found += ASCII_CUT(chunk)
                continue
            cut = self.cuts.get(chunk)
            if cut is None:
                cut = self.of.pretokens(chunk)
                if len(self.cuts) < MERGED and len(chunk) < 40:
                    self.cuts[chunk] = cut
            found += cut
        return found

    def _part(self, text: str) -> int:
        n = at = 0
        while at < len(text):
            border = BORDER.search(text, at + SLICE) if self.of.byte_level and len(text) - at > SLICE else None
            end = border.start() if border else len(text)
            parts = self._pretokens(text[at:end])
            rest = [p for p in parts if p not in self.proven]
            n += len(parts) - len(rest) + sum(map(self._merged, rest))
            at = end
        return n

    def __call__(self, text: str) -> int:
        if not self.of.added.search(text):
            return self._part(text)
        if not self.of.plain:
            return len(self.of.raw.encode(text, add_special_tokens=False).ids)
        parts = self.of.added.split(text)
        return len(parts) - 1 + sum(map(self._part, parts))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document. path: a tokenizer file at the same place on every machine."""
    spark = docs.sparkSession
    whole = proofs(spark, path).where("whole").select("token").collect()  # bounded by the vocabulary, a parameter
    proven = spark.sparkContext.broadcast(frozenset(r["token"] for r in whole))
    kept: list[Counter] = []

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not kept:
            kept.append(Counter(path, proven.value))
        for texts in batches:
            yield pd.Series([kept[0](t) for t in texts], dtype="int64")

    counter = F.pandas_udf(count, "long")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    told = told.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counter("text").alias("n_tokens"))
    return told.withColumn("over_limit", F.col("n_tokens") > limit)
