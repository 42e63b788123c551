"""Periodic runs of words, found by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least max(12, 2 q) words
that no neighbouring word extends with period q. At lag q a run is an island: consecutive places whose word comes again q
places later, max(q, 12 - q) of them at least. How many such places a lag has is counted for all lags of a text at once: for
words that occur often by an exact autocorrelation (the Fourier transforms of the words' places, summed and turned back once),
for rare words by the differences of their places. The border between both is the count at which they cost the same, about
the square root of n log n in long texts, so n words cost n to the power of 1.5 or so at worst, not its square. Only lags with enough matches are
scanned for islands.

Lags are scanned in rising order. Places that lie, with their partner, within a run whose period divides the lag say nothing new:
an island has either only such places, and then its smallest period is that run's, or none. They are taken out of the
counts and of the scan, so every island that is left and long enough is a run. A scan looks at eight places
of each least length first and then only around eight hits in a row, which loses no island.

Texts are read where they lie and nothing is shuffled; memory is bounded by the longest text.

Defined results: a null or blank text has no words and no runs; words are bytes between the six ASCII white-space characters,
compared exactly; repeated rows, those with equal or null ids too, are read each by itself (a null id isn't rewritten); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LEAST = 12
SAMPLES = 8

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def words_of(text: str) -> list[bytes]:
    """The runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split()  # bytes are split at these six


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a part of them repeated to the end, for the ids whose checksum is divisible by ten."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def border(counts: np.ndarray, size: int) -> int:
    """The count up to which differences of places are cheaper than transforms of that size, for words with these counts.

    The prices are nanoseconds of one difference, of one pass over all differences of a step, and of one transform.
    """
    c = np.sort(counts)
    pairs, passes, transforms = 6.0 * np.cumsum(c * c), 12_000.0 * c, (6_000.0 + 2.0 * size * np.log2(size)) * np.arange(len(c) - 1, -1, -1)
    return int(c[np.argmin(pairs + passes + transforms)])


def lag_matches(ids: np.ndarray, most: int, heavy: int | None = None) -> np.ndarray:
    """How many places each lag from 0 to most has whose word comes again so much later. ids: numbers from 0.

    heavy: words that occur more often than this are counted by Fourier transforms, the others by differences of places.
    """
    counts = np.bincount(ids)
    found = np.zeros(most + 1, np.int64)
    size = 1 << int(len(ids) + most).bit_length()  # no lag up to most wraps
    heavy = border(counts, size) if heavy is None else heavy
    often = np.flatnonzero(counts > heavy)
    power = np.zeros(size // 2 + 1)
    at_once = max(1, (1 << 18) // size)  # bounds memory
    for i in range(0, len(often), at_once):
        f = np.fft.rfft(ids == often[i : i + at_once, None], size)
        power += (f.real**2 + f.imag**2).sum(axis=0)
    if len(often):
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)  # whole numbers of at most n; the error is far under a half
    rare = np.flatnonzero(counts[ids] <= heavy)
    places = rare[np.lexsort((ids[rare], -counts[ids[rare]]))]  # words that occur most often first, places rising within a word
    of, times = ids[places], counts[ids[places]]
    for step in range(1, int(times[0]) if len(times) else 0):
        upto = len(times) - int(np.searchsorted(times[::-1], step, "right"))  # only words that occur more often than step
        same = of[step:upto] == of[: upto - step]
        d = (places[step:upto] - places[: upto - step])[same]
        found += np.bincount(d[d <= most], minlength=most + 1)
    return found


def _islands(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last of the stretches of at least so many hits."""
    padded = np.zeros(len(hit) + 2, bool)
    padded[1:-1] = hit
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    first, after = edges[::2], edges[1::2]
    long = after - first >= least
    return list(zip(first[long].tolist(), (after[long] - 1).tolist(), strict=True))


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period. ids: the words as numbers from 0."""
    n = len(ids)
    most = n // 2
    if n < least:
        return []
    lags = np.arange(most + 1)
    matches = lag_matches(ids, most)
    matches[0] = 0
    runs: list[tuple[int, int, int]] = []
    active = np.zeros((0, 3), np.int64)  # start, end, period of the runs that are longer than the lag
    for q in np.flatnonzero(matches >= np.maximum(lags, least - lags)).tolist():
        if q == 0:
            continue
        need = max(q, least - q)
        active = active[active[:, 1] - active[:, 0] > q] if len(active) else active
        known = active[q % active[:, 2] == 0] if len(active) else active
        known = known[np.argsort(known[:, 0])] if len(known) > 1 else known
        # Two of these runs overlap by less than q words, so no place is counted twice.
        if len(known) and matches[q] - (known[:, 1] - q - known[:, 0] + 1).sum() < need:
            continue
        step = max(1, need // SAMPLES)
        hit = ids[: n - q : step] == ids[q::step]
        if len(known):
            hit &= ~_covered(np.arange(0, n - q, step), known, q)
        close = [(max(0, (first - 1) * step + 1), min(n - q, (last + 1) * step)) for first, last in _islands(hit, need // step)]
        new = []
        for lo, hi in close:
            same = ids[lo:hi] == ids[lo + q : hi + q]
            if len(known):
                same &= ~_covered(np.arange(lo, hi), known, q)
            new += [(lo + a, lo + b + q, q) for a, b in _islands(same, need)]
        if new:
            runs += [(s, e - s + 1, q) for s, e, _ in new]
            active = np.concatenate([active, np.array(new, np.int64)])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _covered(at: np.ndarray, known: np.ndarray, q: int) -> np.ndarray:
    """Which places lie with their partner q later within one of the known runs (start, end, period), ordered by start."""
    i = np.searchsorted(known[:, 0], at, "right") - 1
    return (i >= 0) & (at + q <= known[np.maximum(i, 0), 1])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that some run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _read(docs: DataFrame, rewrite: Rewrite | None, row, schema: str) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                words = words_of(text)
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                out += row(doc_id, words, find_runs(numbers(words)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith("long")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(read, schema)


def runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, start, length, period: every run of every text."""
    return _read(docs, rewrite, lambda doc_id, words, found: [(doc_id, *r) for r in found], "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, text: every text with each run cut to its first period, words joined by one space."""

    def row(doc_id, words, found):
        return [(doc_id, b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))]

    return _read(docs, rewrite, row, "doc_id long, text string")


def digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256: one row per text."""

    def row(doc_id, words, found):
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        kept = b" ".join(collapsed(words, found))
        return [(doc_id, len(found), *told, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())]

    return _read(docs, rewrite, row, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
