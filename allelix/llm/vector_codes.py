"""Codes of vectors by codebooks that are learned on distinct integer parts.

Each component becomes the integer floor(scale * x), and vectors are cut into equal consecutive parts. Equal parts at a
position are one row with a weight: an exploded table is counted by position and part, with partial counts before the
shuffle, and written. Weighted Lloyd rounds run over these rows only: every task assigns its rows to the
nearest entry of their position's codebook and sums them up by entry, so a task sends a row an entry and the
driver gets one row an entry (positions times entries, a parameter). Sums and distances are whole numbers, so neither the order of
rows nor that of tasks changes a bit. Finally codes and errors of the distinct parts are joined back to the vectors' parts.

A part may be in a third of all vectors. Parts (and labels) with more than one HEAVY-th of all rows are few by arithmetic: at most
HEAVY a position. They are joined by a broadcast; only the rest is shuffled, so no join key holds more than that share.

Defined results: a vector that is null or holds null or non-finite components is dropped; the first entries of the codebooks are
the parts of the vectors with the smallest ids, null ids last, and of equal ids by their integers; with fewer vectors
than entries the codebooks are shorter; equal entries stay, the first of them is used; an entry without parts stays as it is;
repeated rows, those with equal or null ids too, are vectors each by itself; an empty table gives an empty result; extra columns
are ignored. Vectors of unequal dimension, a dimension that the parts don't divide, and integers over 2**27 (whose
squares need not fit the sums) are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, numbered

HEAVY = 4096
MOST = 1 << 27


def integers(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def whole(embedding: Column) -> Column:
    """No null, no infinite and no undefined component."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def weighted_parts(vectors: DataFrame, parts: int, dim: int) -> DataFrame:
    """part, value, n: the distinct parts of each position and how many vectors have them. vectors: v (array of long)."""
    return exploded(vectors, parts, dim).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


def exploded(vectors: DataFrame, parts: int, dim: int) -> DataFrame:
    """The columns of vectors but v, with part and value: a row for each part of each vector."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * dim + 1, F.lit(dim)))
    return vectors.select(*[c for c in vectors.columns if c != "v"], F.posexplode(cut).alias("part", "value"))


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the first of equals; squared distance) for each row."""
    d = np.zeros((len(values), len(book)), np.int64)
    for i in range(values.shape[1]):
        d += (values[:, i, None] - book[None, :, i]) ** 2
    code = d.argmin(axis=1)
    return code, d[np.arange(len(d)), code]


def _by_part(batches: Iterator[pd.DataFrame], rows: int = 4096) -> Iterator[tuple[int, np.ndarray, pd.DataFrame]]:
    for b in batches:
        for part, g in b.groupby("part", sort=False):
            for at in range(0, len(g), rows):  # bounds the table of distances
                block = g.iloc[at : at + rows]
                yield int(part), np.array(block["value"].tolist(), np.int64).reshape(len(block), -1), block


def lloyd_round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over the rows (part, value, n)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((*count.shape, books[0].shape[1]), np.int64)
        for part, values, block in _by_part(batches):
            n = block["n"].to_numpy()
            code, _ = nearest(values, books[part])
            np.add.at(count[part], code, n)
            np.add.at(total[part], code, values * n[:, None])
        part, entry = np.nonzero(count)
        s = np.concatenate([count[part, entry][:, None], total[part, entry]], axis=1)
        width = s.shape[1]
        yield pd.DataFrame({"part": part.repeat(width), "entry": entry.repeat(width), "place": np.tile(np.arange(width), len(part)), "s": s.ravel()})

    told = distinct.mapInPandas(sums, "part int, entry int, place int, s long")
    told = told.groupBy("part", "entry", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in told.collect():  # a row for each component of each entry
        found.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["s"])
    after = [b.copy() for b in books]
    for (p, e), s in found.items():
        after[p][e] = [s[i] // s[0] for i in range(1, len(s))]
    return after


def codes(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, value, n, code, error: the nearest entry of each distinct part."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, values, block in _by_part(batches):
            code, error = nearest(values, books[part])
            yield block.assign(code=code, error=error)

    return distinct.mapInPandas(assign, "part int, value array<long>, n long, code int, error long")


def joined(left: DataFrame, right: DataFrame, keys: list[str], rows: int, bytes_per_row: int) -> DataFrame:
    """left with the columns of right, which has unique keys and, as n, their number of rows in left; it has every key of left.

    A right side that is small is broadcast. Else its keys with more than one HEAVY-th of left's rows are, and the rest meets by a
    shuffle in which no key is larger than that.
    """
    more = [c for c in right.columns if c not in (*keys, "n")]
    right = right.select("n", *[F.col(k).alias(f"__{k}") for k in keys], *more)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if right.count() * bytes_per_row <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), same).select(*left.columns, *more)
    hot = F.broadcast(right.where(F.col("n") * HEAVY > rows).withColumn("__hot", F.lit(True)))
    met = left.join(hot, same, "left")
    rest = met.where("__hot is null").select(*left.columns).join(right.where(F.col("n") * HEAVY <= rows), same)
    return met.where("__hot").select(*left.columns, *more).union(rest.select(*left.columns, *more))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for entry in b for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per vector that isn't dropped."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = numbered(vectors).where(whole(F.col("embedding")))
    rows = rows.select("__row", F.col("vec_id").cast("long").alias("vec_id"), "label", integers(F.col("embedding"), scale).alias("v"))
    size = F.size("v")
    n, low, high, largest = rows.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if n == 0:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if low != high or high % parts or high == 0:
        raise ValueError(f"vectors of {low} to {high} components can't be cut into {parts} equal parts")
    if largest > MOST:
        raise ValueError(f"a component times {scale} is over {MOST}")
    dim = high // parts
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dim)
    books = [start[:, p].copy() for p in range(parts)]
    distinct = materialize(weighted_parts(rows.select("v"), parts, dim), "distinct-parts")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    coded = materialize(codes(distinct, books), "coded-parts")
    told = joined(exploded(rows, parts, dim), coded, ["part", "value"], n, 8 * dim + 60)
    of = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0"))
    told = told.groupBy("__row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_join(of, "").alias("code"), F.sum("error").alias("error"))
    told = materialize(told, "codes")
    by_label = materialize(told.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    told = joined(told, by_label, ["label"], n, 60)
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
