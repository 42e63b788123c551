"""Best-fit packing of documents into sequences after a Martello-Toth reduction.

Documents are tokenized on the executors and only narrow piece rows leave them. Packing depends on lengths alone, and
there are at most `capacity` of them, so the whole instance is a histogram: the driver reduces it by dominance (sets of
one to three pieces that some best packing contains are fixed, as many at a time as the counts allow), packs the rest
best-fit by falling length, and gets a list of sequence patterns with how often each occurs. The list is bounded by the
capacity, not by the data. Each piece then gets its rank within its length (counted by hashed buckets of some bucket_rows
rows, more for a common length, so that no length meets in one task) and the pattern that holds this rank.

Defined results: a null text is empty and gives the one token that ends a document; only documents over the capacity
are cut, the first piece being the shorter one; repeated rows, those with equal or null ids too, are packed each by itself; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, small_batches

END = 2
CACHE = 500_000
#: The pre-tokenizer's pattern for ASCII texts, and its letter for a space.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+").findall
SPACE = "\u0120"
_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, by a tokenizer file of the `tokenizers` library without special tokens.

    The vocabulary's tokens never reach over the border between a word and the white space after it, so texts are encoded
    chunk by chunk (a space with the word after it, or a run of white space) through a dictionary of at most CACHE entries;
    a new chunk is cut by the file's pre-tokenizer, and its parts go through a second such dictionary to the file's model.
    Ids are the same as those of the whole text. Texts with added tokens or control characters that not all libraries
    take for white space are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        self.raw = Tokenizer.from_file(path)
        added = [t.content for t in self.raw.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, added)]))
        self.chunks = re.compile(r" ?\S+|\s+(?!\S)|\s").findall
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cut, self.tokenize = self.raw.pre_tokenizer.pre_tokenize_str, self.raw.model.tokenize
        if self.raw.normalizer is not None:
            raise ValueError(f"{path} changes texts before it cuts them")
        self.runs = re.compile(r"\s\s|[^\S ]|\s$")

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.raw.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():  # cut as the pre-tokenizer does; the model knows a space by another letter
            cut = [p.replace(" ", SPACE) for p in WORDS(chunk)] if chunk.isprintable() else [p for p, _ in self.cut(chunk)]
        else:
            cut = [p for p, _ in self.cut(chunk)]
        found = list(map(self.parts.get, cut))
        for i, part in enumerate(cut):
            if found[i] is None:
                found[i] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(part)])
                if len(self.parts) < CACHE and len(part) < 40:
                    self.parts[part] = found[i]
        return b"".join(found)

    def __call__(self, text: str) -> bytes:
        if self.whole.search(text):
            return self._encode(text)
        if self.runs.search(text):
            chunks = self.chunks(text)
        else:
            first, *words = text.split(" ")
            chunks = [first, *(" " + w for w in words)]
        found = list(map(self.known.get, chunks))
        if None in found:
            for i in [i for i, ids in enumerate(found) if ids is None]:
                chunk = chunks[i]
                found[i] = ids = self._chunk(chunk)
                if len(self.known) < CACHE and len(chunk) < 40:
                    self.known[chunk] = ids
        return b"".join(found)


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = (encode(text) if text else b"") + END.to_bytes(4, "little")
                out += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets of the histogram (counts[length], changed in place); returns [(lengths, times)].

    For each piece j, from the largest, with i the largest other piece that fits beside it:
    j alone is best if nothing fits; j with i is best if they fill the sequence, if no two other pieces fit beside j at once,
    or if no three do and no two make up more than i; where no three do and the best two, a and b, hold i, j with
    both is best unless two pieces that are larger than b, other than i, fit beside j too. In each case any set with j can be
    exchanged for the one that is fixed without more sequences. The search goes on with the next length where none holds.
    What holds depends on no more than four pieces of a length, so many sets are fixed at once while more than that are left.
    """
    fixed = []

    def fix(*lengths: int) -> None:
        uses = Counter(lengths)
        times = max(1, min((int(counts[w]) - 4) // k for w, k in uses.items()))
        for w, k in uses.items():
            counts[w] -= k * times
        fixed.append((lengths, times))

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1
            fit = np.flatnonzero(counts[: room + 1])
            few = np.repeat(fit, np.minimum(counts[fit], 4))  # rising, each length up to four times
            counts[j] += 1
            if not len(few):
                fixed.append(((j,), int(counts[j])))
                counts[j] = 0
                continue
            i = int(few[-1])
            if i == room or len(few) < 2 or few[0] + few[1] > room:
                fix(j, i)
                continue
            if len(few) >= 3 and few[0] + few[1] + few[2] <= room:
                break
            at = np.searchsorted(few, room - few, "right") - 1  # the largest partner of each, at another place
            at = np.where(at >= np.arange(len(few)), np.minimum(at, np.arange(len(few)) - 1), at)
            pair = np.where(at >= 0, few + few[np.maximum(at, 0)], 0)
            most = int(pair.max())
            if i >= most:
                fix(j, i)
                continue
            b = most - i
            others = few[:-1]
            larger = others[others > b][:2]
            if b not in others or len(larger) == 2 and larger.sum() <= room:
                break
            fix(j, i, b)
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit by falling length over the histogram; groups of equally filled sequences move together."""
    open_: dict[int, list[list]] = {}  # room -> [[lengths, times]]
    for w in range(capacity, 0, -1):
        m = int(counts[w])
        room = w
        while m:
            while room <= capacity and not open_.get(room):
                room += 1
            if room > capacity:
                k = capacity // w
                for each, times in ((k, m // k), (m % k, 1)):
                    if each and times:
                        open_.setdefault(capacity - each * w, []).append([((w, each),), times])
                break
            lengths, times = open_[room].pop()
            k = room // w
            n = min(times, m // k)
            if n:
                open_.setdefault(room - k * w, []).append([(*lengths, (w, k)), n])
                m -= n * k
                times -= n
            if times and m:  # fewer than k are left: they go into one sequence
                open_.setdefault(room - m * w, []).append([(*lengths, (w, m)), 1])
                times, m = times - 1, 0
            if times:
                open_.setdefault(room, []).append([lengths, times])
    return [(tuple(w for w, k in lengths for _ in range(k)), times) for groups in open_.values() for lengths, times in groups]


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return [(p, n) for p, n in [*reduce_instance(counts, capacity), *best_fit(counts, capacity)] if n]


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence id, pieces of this length a sequence, their first offset)."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for lengths, times in found:
        at = 0
        for w in sorted(set(lengths), reverse=True):
            k = lengths.count(w)
            rows.setdefault(w, []).append((rank.get(w, 0), base, k, at))
            rank[w] = rank.get(w, 0) + k * times
            at += k * w
        base += times
    return {w: np.array(r, np.int64) for w, r in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = 1024, bucket_rows: int = 500) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with small_batches(docs.sparkSession):
        pieces = materialize(tokenized(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    where = slots(patterns(histogram, capacity))
    sizes = docs.sparkSession.createDataFrame([(w, -(-n // bucket_rows)) for w, n in histogram.items()], "length long, buckets long")
    keyed = pieces.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    per = materialize(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "length-buckets")
    first = per.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = keyed.withColumn("nth", F.row_number().over(own)).join(small(first, 32), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for w in np.unique(lengths):
            at = np.flatnonzero(lengths == w)
            rows = where[int(w)]
            hit = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
            q = ranks[at] - hit[:, 0]
            sequence[at] = hit[:, 1] + q // hit[:, 2]
            offset[at] = hit[:, 3] + q % hit[:, 2] * w
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    told = ranked.withColumn("at", place("length", "rank"))
    return told.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
