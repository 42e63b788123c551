"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

The features are the square roots of hashed character n-gram counts (one to three characters, lower case) of the whole
text, scaled to length one. Fitting takes a bounded sample of labelled rows (`per_language` rows of each language, 500
unless set, chosen by a hash of the id); their sparse feature vectors, never texts, go to the driver. Families are told apart
by one linear machine each, against all others, so their number grows with the families; only the chosen family's
machines, one for each pair of its languages, are asked then. Prediction reads every text on the executors and uses the text
alone.

Defined results: a null text or one without any letter (Unicode category L) is `und` with score 0; if only one language was
learned, every other text gets it with score 1; if none was, every text is `und`; of languages with equal votes the one with
the higher sum of scores wins, then the first by name; repeated rows get equal rows, a row without an id is never held out and
learned from like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

DIMS = 4096
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")

#: ISO 639-1 codes by language family. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "hi", "mr", "ne", "pa", "ur"],
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def features(text: str, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the hashed n-gram vector of the whole text, read in chunks of bounded memory."""
    counts = np.zeros(DIMS, np.int64)
    text = " " + text + " "
    for at in range(0, len(text), chunk):
        before = text[max(0, at - 2) : at].lower()[-2:]
        c = np.frombuffer((before + text[at : at + chunk].lower()).encode("utf-32-le", "replace"), np.uint32)
        n = len(before)  # n-grams that end in this chunk are counted with it
        h = c * np.uint32(0x9E3779B1)
        two = (h[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0x27D4EB2F)
        three = (two[:-1] ^ (c[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x165667B1)
        for x in (h[n:], two[max(0, n - 1) :], three[max(0, n - 2) :]):
            counts += np.bincount(x >> np.uint32(20), minlength=DIMS)
    at = np.flatnonzero(counts)
    v = np.sqrt(counts[at])
    return at.astype(np.int32), (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        f = [features(t) for t in b["text"]]
        yield pd.DataFrame({"lang": b["lang"], "doc_id": b["doc_id"], "at": [x[0].tobytes() for x in f], "value": [x[1].tobytes() for x in f]})


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last one the bias) of a linear support vector machine with squared hinge loss, by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    c = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    w, a, q, rng = np.zeros(x.shape[1]), np.zeros(len(y)), np.einsum("ij,ij->i", x, x) + 1 / (2 * c), np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + a[i] / (2 * c[i])
            new = max(0.0, a[i] - g / q[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


class LanguageModel:
    """families: {family: [language]}; of: one machine a family; within: {family: (pairs of languages, their machines)}."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, family=FAMILY):
        self.families: dict[str, list[str]] = {}
        for code in sorted(set(lang)):
            self.families.setdefault(family.get(code, code), []).append(code)
        of = np.array([family.get(code, code) for code in lang])
        self.names = sorted(self.families)
        self.of = np.array([fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in self.names], np.float32) if len(self.names) > 1 else None
        self.within = {}
        for f, codes in self.families.items():
            pairs = list(combinations(codes, 2))
            if pairs:
                rows = [(lang == a) | (lang == b) for a, b in pairs]
                self.within[f] = pairs, np.array([fit_svm(x[r], np.where(lang[r] == a, 1.0, -1.0)) for r, (a, b) in zip(rows, pairs, strict=True)], np.float32)

    def _family(self, at: np.ndarray, value: np.ndarray) -> tuple[str, float]:
        if self.of is None:
            return self.names[0], 1.0
        margins = self.of[:, at] @ value + self.of[:, -1]
        best = int(np.argmax(margins))
        p = np.exp(2.5 * (margins - margins[best]))
        return self.names[best], float(1 / p.sum())

    def _language(self, family: str, at: np.ndarray, value: np.ndarray) -> tuple[str, float]:
        names = self.families[family]
        if len(names) == 1:
            return names[0], 1.0
        pairs, w = self.within[family]
        won, score = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), m in zip(pairs, w[:, at] @ value + w[:, -1], strict=True):
            p = 1 / (1 + np.exp(-np.clip(2.5 * m, -50, 50)))
            won[a if m >= 0 else b] += 1
            score[a] += p
            score[b] += 1 - p
        best = max(names, key=lambda n: (won[n], score[n]))
        return best, float(score[best] / (len(names) - 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not LETTER.search(text):
            return "und", 0.0
        at, value = features(text)
        family, p = self._family(at, value)
        code, q = self._language(family, at, value)
        return code, min(1.0, p * q)


def held_out(doc_id="doc_id"):
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 500) -> LanguageModel:
    """Learn from text and lang of the rows outside the held-out fold, at most per_language rows of each language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    wanted = rows.join(small(sizes, 40), "lang").where(share < 1.3 * per_language / F.col("n"))
    wanted = wanted.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # repeated ids count once, which keeps the sample bounded
    sample = wanted.mapInPandas(_vectors, "lang string, doc_id long, at binary, value binary").toPandas()  # bytes, as lists of numbers take ten times the driver's memory
    if not len(sample):
        return LanguageModel(np.zeros((0, DIMS), np.float32), np.array([], object))
    sample = sample.sort_values(["lang", "doc_id"]).groupby("lang").head(per_language)
    x = np.zeros((len(sample), DIMS), np.float32)
    for i, (at, value) in enumerate(zip(sample["at"], sample["value"], strict=True)):
        x[i, np.frombuffer(at, np.int32)] = np.frombuffer(value, np.float32)
    return LanguageModel(x, sample["lang"].to_numpy())


def predict(docs: DataFrame, model: LanguageModel, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of docs with the language and its score, which replace columns of these names; the text alone is read."""

    @F.pandas_udf("lang_pred string, score double")
    def told(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score"])

    return docs.withColumn("__told", told(F.col("text"))).withColumns({lang_col: F.col("__told.lang_pred"), score_col: F.col("__told.score")}).drop("__told")


def identify(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(rows, fit(docs, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
