"""Near-deduplication with Order MinHash and banded alignment.

The words of a text give k-mers of five words, two empty words before and after the text included, each labelled with how
often it occurred before in the text. Each of `sketches` hash functions picks the `picks` smallest labelled k-mers and keeps
them in text order; the resulting tuple is a bucket key, so buckets hold texts that share k-mers in the same order. Exact
copies are one class first. In each bucket every class is paired with the smallest one; pairs are made distinct, and each is
verified by a banded alignment of the words: texts link if 1 - distance / longer length is at least the similarity (0.8),
the distance being insertions, deletions and changes of words. A bag of the words in few bits (word_bag) tells of most
pairs that they can't be similar, so that their texts aren't read. Classes that failed with their bucket's
leader are dealt again to the smallest of themselves, as long as a quarter of such pairs links. Then the classes that failed
with the first leader are compared with all texts of their buckets outside their component, by lengths and bags, in blocks of rows. Pairs
that these leave are aligned, first one for each class and component, then the others
of the components that it failed with. So any two similar texts that share a bucket end in one group. Components of the links
are the groups; the row with the smallest doc_id stays. The last step is quadratic in texts of a bucket that
aren't similar, at a few bytes a pair; blocks of them, and pairs with nearly the same words, are rows. Texts without buckets can be joined by their
rarest words instead (_rest).

Where a share e of the words changed at random places, a k-mer stays with (1 - e) ** 5 and the share J of common k-mers among
all is that over two less it; a pair shares a bucket but for (1 - J ** 2) ** 72. That is 0.06 at an edit similarity of 0.8 and
under 0.001 at 0.85. In a short text a change takes a larger part of such k-mers, so texts of up to SHORT words also have 24
sketches of labelled k-mers of two words (one empty word before and after); pairs of which one text is longer have 40 words
or more each if they are similar. tests/llm/test_near_recall.py measures recall by length and similarity.

Defined results: a text that is null or has no words links with nothing; rows that share a doc_id are rows of their own; a
group is told by its smallest doc_id (null if it has none), and exactly one row of it stays: of rows with that doc_id the one
with the smallest digest, and of equal ones any; texts under five words are k-mers with empty words; an empty table gives an
empty result; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small, small_batches

PRIME = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)
UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))  # BASE * UNBASE is 1 in 64 bits
_powers, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Labelled words are counted in PARTS * LEVELS bins to tell rare ones from frequent ones.
PARTS, LEVELS = 64, 1 << 14
#: A row of a rare word carries so many of those before it, by which most pairs that met there are left out.
BEFORE = 4
#: Texts of up to this many words have keys of k-mers of two words too.
SHORT = 48
#: Texts of up to this many words are aligned with many others at once.
TABLED = 2048
#: From so many on that is faster than one by one.
TOGETHER = 64
#: Bags have at least and at most so many bins.
LEAST_BINS, MOST_BINS = 1 << 8, 1 << 14


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def word_hashes(words: list[str], at_once: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, made for all words at once."""
    global _powers, _inverse
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(words), at_once):  # bounds memory for long texts
        b = np.frombuffer((" ".join(words[at : at + at_once]) + " ").encode("utf-8", "replace"), np.uint8)
        while len(_powers) < len(b):
            _powers, _inverse = np.r_[_powers, _powers * _powers[-1] * BASE], np.r_[_inverse, _inverse * _inverse[-1] * UNBASE]
        starts = np.r_[0, np.flatnonzero(b == 32)[:-1] + 1]
        out.append(_mix(np.add.reduceat(b * _powers[: len(b)], starts) * _inverse[starts]))
    return np.concatenate(out)


def labelled_kmers(words: list[str], k: int, pad: int = 2, hashes: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the k-mers with their occurrence numbers, in text order; pad empty words stand before and after the text. hashes: those of the words, if they are made already."""
    w = np.full(len(words) + 2 * pad, 1 << 32, np.uint64)
    w[pad : pad + len(words)] = word_hashes(words) if hashes is None else hashes
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = _mix(h * PRIME + w[i : len(w) - k + 1 + i] + np.uint64(1))
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(h + nth * PRIME)


def order_minhash(h: np.ndarray, sketches: int, picks: int) -> np.ndarray:
    """One signed 64-bit bucket key per sketch: the picks smallest k-mers under its hash function, in text order."""
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    odd = _mix(seeds) | np.uint64(1)
    picked = np.zeros((sketches, picks), np.uint64)
    n = min(picks, len(h))
    step = max(1, (1 << 17) // len(h))  # bounds memory for long texts
    for s in range(0, sketches, step):
        v = (h[None, :] ^ seeds[s : s + step, None]) * odd[s : s + step, None]  # the k-mers are mixed already
        row, at = np.arange(len(v)), np.empty((len(v), n), np.int64)
        for i in range(n):
            at[:, i] = v.argmin(axis=1)
            v[row, at[:, i]] = MOST
        picked[s : s + step, :n] = h[np.sort(at, axis=1)]
    key = seeds
    for i in range(picks):
        key = _mix(key * PRIME ^ picked[:, i])
    return key.view(np.int64)


def word_bag(hashes: np.ndarray) -> bytes:
    """Of a text's word hashes, a bit for each of some bins, two or more a word: whether an odd number of the labelled words lies there.

    Bags of two texts differ in as many bins at most as there are labelled words that only one text has, so in 2 * band less the
    difference of their lengths if they are similar. The halves of a bag, one upon the other, are the bag of half as many bins.
    """
    bins = min(max(1 << (2 * len(hashes) - 1).bit_length(), LEAST_BINS), MOST_BINS)
    s, at = np.sort(hashes), np.arange(len(hashes))
    nth = at - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
    n = np.bincount((_mix(s + nth.astype(np.uint64) * PRIME) % np.uint64(bins)).astype(np.int64), minlength=bins)
    return np.packbits(n & 1 == 1).tobytes()


def _folded(bags: np.ndarray, wide: int) -> np.ndarray:
    while bags.shape[1] > wide:
        half = bags.shape[1] // 2
        bags = bags[:, :half] ^ bags[:, half:]
    return bags


class _Bags:
    """Lengths and bags of some texts, to compare many pairs of them at once."""

    def __init__(self, words: pd.Series, bags: pd.Series):
        self.words = words.to_numpy(np.int64)
        self.wide = np.array([len(b) // 8 for b in bags], np.int64)
        self.at, self.of, self.least = np.zeros(len(bags), np.int64), {}, np.zeros((len(bags), LEAST_BINS // 64), np.uint64)
        bags = bags.to_numpy()
        for wide in np.unique(self.wide).tolist():
            rows = np.flatnonzero(self.wide == wide)
            self.at[rows] = np.arange(len(rows))
            self.of[wide] = np.frombuffer(b"".join(bags[rows]), np.uint64).reshape(len(rows), wide)
            self.least[rows] = _folded(self.of[wide], self.least.shape[1])


def alike(a: _Bags, x: np.ndarray, b: _Bags, y: np.ndarray, similarity: float, at_once: int = 1 << 12) -> np.ndarray:
    """Which of the pairs of the rows x of a and y of b, by their place, lengths and bags let be similar."""
    apart = np.abs(a.words[x] - b.words[y])
    band = (np.maximum(a.words[x], b.words[y]) * (1 - similarity) + 1e-9).astype(np.int64)
    most = 2 * band - apart
    left = np.flatnonzero(apart <= band)
    left = left[np.bitwise_count(a.least[x[left]] ^ b.least[y[left]]).sum(axis=1, dtype=np.int64) <= most[left]]
    parts = [left[:0]]
    for p in a.of:
        for q in b.of:
            here = left[(a.wide[x[left]] == p) & (b.wide[y[left]] == q)]
            for lo in range(0, len(here), at_once):
                some, wide = here[lo : lo + at_once], min(p, q)
                differ = _folded(a.of[p][a.at[x[some]]], wide) ^ _folded(b.of[q][b.at[y[some]]], wide)
                parts.append(some[np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most[some]])
    return np.sort(np.concatenate(parts))


def banded_distance(a: list[str], b: list[str], band: int) -> int:
    """Edit distance in words if it is at most band, else band + 1.

    The band of 2 * band + 1 diagonals of the alignment matrix is held as bit vectors of vertical differences in two Python
    integers and moves down by one row with each word of b.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > band:
        return band + 1
    lo = 0
    while lo < len(a) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a:
        return len(b)
    if max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > band:
        return band + 1
    try_band = 64
    while True:
        width = min(band, try_band)
        if len(b) - len(a) <= width:
            d = _in_band(a, b, width)
            if d <= width:
                return d
        if width == band:
            return band + 1
        try_band *= 4


def _in_band(a: list[str], b: list[str], band: int) -> int:
    """Distance if it is at most band, else a larger number. Bit i of a column j stands for row j - band + i of the matrix."""
    m, n = len(a), len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    width = 2 * band + 1
    full = (1 << width) - 1
    # Rows above the matrix count as matching nothing and cost one a step, so the start column rises by one a row below row 0.
    up, down, score = full ^ ((1 << band) - 1), 0, 0
    for j in range(1, n + 1):
        shift = j - 1 - band
        bits = where.get(b[j - 1], 0)
        match = (bits >> shift if shift >= 0 else bits << -shift) & full
        diagonal = (((match & up) + up) & full ^ up) | match | down
        plus = (down | ~(diagonal | up)) & full
        minus = diagonal & up
        if j <= m:
            if not diagonal >> band & 1:
                score += 1
        else:
            bit = band - (j - m)
            score += (plus >> bit & 1) - (minus >> bit & 1)
        up = (minus | ~((diagonal >> 1) | plus)) & full
        down = (diagonal >> 1) & plus
    return score


def distances_to(one: np.ndarray, many: np.ndarray, lengths: np.ndarray, band: int) -> np.ndarray:
    """Edit distance of one sequence of word numbers to each row of many, filled up with -1 beyond its length, where it is at most band; else a larger number.

    All matrices move down by a row at a time; of a row, the 2 * band + 1 columns round the diagonal are held, each less its place, so
    that a word lacking after another is a running minimum.
    """
    far, wide, count = np.int16(1 << 14), 2 * band + 1, len(many)
    padded = np.full((2 * band + max(many.shape[1], len(one)) + 1, count), -1, np.int32)
    padded[band : band + many.shape[1]] = many.T
    row = np.full((wide, count), far, np.int16)  # column c of row n stands at c - n + band
    row[band:] = -band
    differs, new = np.empty((wide, count), bool), np.empty((wide, count), np.int16)
    for n, x in enumerate(one, 1):
        np.not_equal(padded[n - 1 : n - 1 + wide], x, out=differs)
        np.add(row, differs, out=new)
        row[1:] += 2
        np.minimum(new[:-1], row[1:], out=new[:-1])
        if n <= band:
            new[: band - n] = far
            new[band - n] = 2 * n - band
        shift = 1
        while shift < wide:  # the running minimum in few steps over all columns, which is faster than accumulate
            np.copyto(row, new)
            np.minimum(new[shift:], new[:-shift], out=row[shift:])
            row, new, shift = new, row, 2 * shift
        row, new = new, row
    at = lengths - len(one) + band
    inside = (at >= 0) & (at < wide)
    at = np.clip(at, 0, wide - 1)
    return np.where(inside, row[at, np.arange(count)] + at, 1 << 20)


def similar(a: str, b: str, similarity: float) -> bool:
    x, y = a.split(), b.split()
    longer = max(len(x), len(y))
    band = int(longer * (1 - similarity) + 1e-9)
    return bool(x and y) and banded_distance(x, y, band) <= band


def similar_to(one: str, many: list[str], similarity: float) -> list[bool]:
    """Whether one is similar to each of many; those that could be are aligned at once if they are many and not long."""
    x = one.split()
    if len(many) < TOGETHER or not x or len(x) > TABLED:
        return [similar(one, other, similarity) for other in many]
    own, known = Counter(x), {}
    number = lambda ws: [known.setdefault(w, len(known)) for w in ws]
    one_ids, out, some = np.array(number(x), np.int32), [False] * len(many), []
    for i, other in enumerate(many):
        y = other.split()
        longer = max(len(x), len(y))
        band = int(longer * (1 - similarity) + 1e-9)
        if y and longer - min(len(x), len(y)) <= band and longer - (own & Counter(y)).total() <= band:
            some.append((i, y, band))
    for lo in range(0, len(some), 256):
        part = some[lo : lo + 256]
        if len(part) < TOGETHER:
            for i, y, band in part:
                out[i] = banded_distance(x, y, band) <= band
            continue
        ids, lengths, bands = np.full((len(part), max(len(y) for _, y, _ in part)), -1, np.int32), np.array([len(y) for _, y, _ in part]), [b for *_, b in part]
        for r, (_, y, _) in enumerate(part):
            ids[r, : len(y)] = number(y)
        for (i, *_), near in zip(part, distances_to(one_ids, ids, lengths, max(bands)) <= bands, strict=True):
            out[i] = bool(near)
    return out


def keys_of(words: list[str], k: int, sketches: int, picks: int, short: int = SHORT, short_sketches: int = 24, hashes: np.ndarray | None = None) -> np.ndarray:
    """The bucket keys of a text. Up to `short` words it also has keys of k-mers of two words, of which more stay when a word changes.

    A text under four fifths of `short` has no similar text over it, so a third of its keys of longer k-mers is enough.
    """
    if len(words) > short:
        return order_minhash(labelled_kmers(words, k, 2, hashes), sketches, picks)
    keys = order_minhash(labelled_kmers(words, k, 2, hashes), sketches if 5 * len(words) >= 4 * short else -(-sketches // 3), picks)
    return np.concatenate([keys, order_minhash(labelled_kmers(words, 2, 1, hashes), short_sketches, picks)])


def sketched(docs: DataFrame, k: int, sketches: int, picks: int, row_col: str | None = None) -> DataFrame:
    """row, doc_id, digest, keys, words (their number), bag of every text; those without words have no keys. Rows are told by row_col or by numbers given here."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, words, bags = [], [], []
            for t in b["text"]:
                w = t.split()
                h = word_hashes(w)
                keys.append(keys_of(w, k, sketches, picks, hashes=h) if w else [])
                words.append(len(w))
                bags.append(word_bag(h) if w else b"")
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"].astype("Int64"), "digest": b["digest"], "keys": keys, "words": words, "bag": bags})

    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("digest", F.sha2("text", 256)).mapInPandas(sketch, "row long, doc_id long, digest string, keys array<long>, words int, bag binary")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, similarity) for x, y in zip(a, b, strict=True)])

    both = pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("rep").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", same("a", "b").alias("same"))


def _alike(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """u, v, alike of the pairs (u, v): whether lengths and bags (rep, words, bag) let them be similar."""

    @F.pandas_udf("boolean")
    def told(n: pd.Series, a: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
        out, at = np.zeros(len(n), bool), np.arange(len(n))
        out[alike(_Bags(n, a), at, _Bags(m, b), at, similarity)] = True
        return pd.Series(out)

    of = lambda node, n, bag: bags.select(F.col("rep").alias(node), F.col("words").alias(n), F.col("bag").alias(bag))
    return pairs.join(of("u", "n", "a"), "u").join(of("v", "m", "b"), "v").select("u", "v", told("n", "a", "m", "b").alias("alike"))


def _aligned(pairs: DataFrame, texts: DataFrame, similarity: float, block: int = 128) -> DataFrame:
    """As _verified, for pairs in dense groups: dealt in tiles of texts that have the same smallest partner, to which each text goes once."""
    of = pairs.groupBy("u").agg(F.min("v").alias("k"), F.count(F.lit(1)).alias("n"))
    sizes = of.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).alias("ni"), F.ceil(F.max("n") / block).alias("nj"))
    of = materialize(of.drop("n").join(sizes, "k"), "tiles")
    deal = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    dealt = materialize(pairs.join(small(of, 40), "u").select("u", "v", F.xxhash64("k", deal("u", "ni"), deal("v", "nj")).alias("tile")), "tiled")
    needed = dealt.select(F.col("tile").alias("of"), F.col("u").alias("rep")).union(dealt.select("tile", "v")).distinct().join(texts.select("rep", "text"), "rep")

    def align(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        text = dict(zip(texts["rep"], texts["text"], strict=True))
        pairs = pairs.sort_values(["u", "v"], ignore_index=True)
        same = [x for u, vs in pairs.groupby("u")["v"] for x in similar_to(text[u], [text[v] for v in vs], similarity)]
        return pd.DataFrame({"u": pairs["u"], "v": pairs["v"], "same": np.array(same, bool)})

    return dealt.groupBy("tile").cogroup(needed.groupBy("of")).applyInPandas(align, "u long, v long, same boolean")


def _candidates(keyed: DataFrame) -> DataFrame:
    """Of keyed (key, rep): every member with the bucket's smallest one."""
    lead = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "lead")
    return keyed.join(lead, "key").where("rep <> lead")


def _levels(texts: DataFrame) -> np.ndarray:
    """How often the labelled words of texts occur, as an eighth of a power of two, of each of PARTS * LEVELS bins of them: a bounded table, whatever the vocabulary."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(PARTS * LEVELS, np.int64)
        for b in batches:
            for t in b["text"]:
                np.add.at(n, _bin(labelled_kmers(t.split(), 1, 0)), 1)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"part": at // LEVELS, "at": at % LEVELS, "n": n[at]})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        level = np.zeros(LEVELS, np.uint8)
        level[rows["at"]] = np.minimum(8 * np.log2(rows["n"]) + 1, 255)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "level": [level.tobytes()]})

    sums = texts.select("text").mapInPandas(counted, "part int, at int, n long").groupBy("part", "at").agg(F.sum("n").alias("n"))
    parts = materialize(sums.groupBy("part").applyInPandas(packed, "part int, level binary"), "levels")
    levels = np.zeros((PARTS, LEVELS), np.uint8)
    for r in parts.collect():  # PARTS rows of LEVELS bytes at most
        levels[r.part] = np.frombuffer(r.level, np.uint8)
    return levels.ravel()


def _bin(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(PARTS * LEVELS)).astype(np.int64)


def rare_words(words: list[str], levels: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest labelled words of a text, by level and then by hash, one more than it may lose: two similar texts share one of them at least."""
    h = labelled_kmers(words, 1, 0)
    return h[np.lexsort((h, levels[_bin(h)]))][: int(len(words) * (1 - similarity) + 1e-9) + 1].view(np.int64)


def _close(a: pd.DataFrame, b: pd.DataFrame, similarity: float, first: bool, at_once: int = 1 << 20) -> pd.DataFrame:
    """u, c, v, more: for the strays a and members b of equal tokens, those of different components that lengths and bags, or places of the token, let be similar.

    Without bags, pairs that share one of the words just before the token in their order are left to that word.

    first: only the smallest v of each component c, and more tells that there are others.
    """
    b = b.sort_values("token", kind="stable")
    told = ["rep", "c"] if "bag" in a else ["rep", "c", "words", "at"]
    token, *member = (b[n].to_numpy() for n in ("token", *told))
    stray = [a[n].to_numpy() for n in told]
    if "bag" in a:
        stray_bags, member_bags = _Bags(a["words"], a["bag"]), _Bags(b["words"], b["bag"])
    else:
        before = [f"before{k}" for k in range(BEFORE)]
        stray_before, member_before = a[before].to_numpy(), b[before].to_numpy()
    lo, hi = np.searchsorted(token, a["token"]), np.searchsorted(token, a["token"], "right")
    ends, parts, start = np.cumsum(hi - lo), [], 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, "right")))
        n = (hi - lo)[start:stop]
        x = np.repeat(np.arange(start, stop), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start:stop], n)
        apart = np.flatnonzero(stray[1][x] != member[1][y])
        x, y = x[apart], y[apart]
        if "bag" in a:
            near = alike(stray_bags, x, member_bags, y, similarity)
            x, y = x[near], y[near]
        else:
            longer = np.maximum(stray[2][x], member[2][y])
            band = (longer * (1 - similarity) + 1e-9).astype(np.int64)
            # Words before the first that both share aren't shared; at later ones too little is asked, never too much of the first.
            near = np.minimum(stray[2][x] - stray[3][x], member[2][y] - member[3][y]) >= longer - band
            x, y = x[near], y[near]
            met = np.zeros(len(x), bool)
            for k in range(BEFORE):
                one = stray_before[x, k]
                met |= ((member_before[y] == one[:, None]).any(axis=1)) & (one != token[y])  # the token itself stands for none
            x, y = x[~met], y[~met]
        parts.append(pd.DataFrame({"u": stray[0][x], "c": member[1][y], "v": member[0][y]}).drop_duplicates())
        start = stop
    out = pd.concat(parts, ignore_index=True).drop_duplicates() if parts else pd.DataFrame({"u": [], "c": [], "v": []}, dtype="int64")
    if first:
        out = out.groupby(["u", "c"], as_index=False).agg(v=("v", "min"), n=("v", "size"))
        return out.assign(more=out.pop("n") > 1)
    return out.assign(more=False)


def _near(tokens: DataFrame, strays: DataFrame, similarity: float, first: bool, block: int = 2048) -> DataFrame:
    """u, c, v, more (see _close) of rare words (rep, c, words, tokens), or buckets and bags (rep, c, words, tokens, bag), and strays (rep), a row each for u, c and, unless first, v.

    Tokens of few rows share a task; rows of others are dealt in blocks, and a task takes a block of either side. Tokens of one
    component, or without a stray, have nothing to tell.
    """
    if "bag" in tokens.columns:
        before = ["bag"]
    else:
        before = [F.coalesce(F.get("tokens", F.col("at") - k - 1), F.col("token")).alias(f"before{k}") for k in range(BEFORE)]
    tokens = tokens.join(small(strays.withColumn("stray", F.lit(True)), 16), "rep", "left").withColumn("stray", F.coalesce("stray", F.lit(False)))
    tokens = tokens.select("*", F.posexplode("tokens").alias("at", "token")).select("token", "at", "rep", "c", "words", "stray", *before)
    sizes = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.count_if("stray").alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).where("s > 0 and low < high")
    sizes = materialize(sizes.select("token", F.ceil(F.col("s") / block).cast("int").alias("s"), F.ceil(F.col("m") / block).cast("int").alias("m"), F.col("m").alias("rows")), "token-blocks")
    total, number = sizes.agg(F.sum("rows"), F.count(F.lit(1))).first()
    bundles = max(1, (total or 0) // block)
    rows = tokens.join(small(sizes.drop("rows"), 24, number), "token")
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sides = F.array(
        F.struct(F.lit(False).alias("left"), every("s").alias("i"), F.array(dealt("m")).alias("j")),
        F.struct(F.lit(True).alias("left"), F.array(dealt("s")).alias("i"), every("m").alias("j")),
    )
    sides = F.when(F.col("stray"), sides).otherwise(F.slice(sides, 1, 1))
    rows = rows.withColumn("side", F.explode(sides)).withColumn("i", F.explode("side.i")).withColumn("j", F.explode("side.j")).withColumn("left", F.col("side.left")).drop("side", "stray", "s", "m")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("token", "i", "j"), F.lit(bundles)))

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        out = [_close(g[g["left"]], g[~g["left"]], similarity, first, 1 << 18) for _, g in rows.groupby(["i", "j"])]
        return pd.concat(out, ignore_index=True).astype({"u": "int64", "c": "int64", "v": "int64", "more": "bool"})

    found = rows.groupBy("g").applyInPandas(close, "u long, c long, v long, more boolean")
    if not first:
        return found.distinct()
    return found.groupBy("u", "c").agg(F.min("v").alias("v"), (F.max("more") | (F.min("v") < F.max("v"))).alias("more"))


def _rest(strays: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """u, v: links of the strays (rep) with other texts (rep, text), of other components, one for each stray and component that has any; they needn't share a bucket.

    Two texts that are similar share as many labelled words as the longer has, less the band, so they share one of the rarest
    of either, one more than the band; under it they meet, in any order of all words.
    """
    levels = texts.sparkSession.sparkContext.broadcast(_levels(texts))

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [t.split() for t in b["text"]]
            yield pd.DataFrame({"rep": b["rep"], "words": [len(w) for w in words], "tokens": [rare_words(w, levels.value, similarity) for w in words]})

    rows = texts.mapInPandas(rare, "rep long, words int, tokens array<long>").join(nodes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    tokens = materialize(rows.select("rep", "words", F.coalesce("component", "rep").alias("c"), "tokens"), "rare-words")
    return _met(tokens, strays, lambda pairs: texts, similarity)


def _met(tokens: DataFrame, strays: DataFrame, texts_of, similarity: float) -> DataFrame:
    """u, v: links of the strays (rep) with texts of equal tokens (see _near), of other components, one for each stray and component that has any.

    A stray is first aligned with one member of each component, and with all others of the components that it failed with.
    """
    met = materialize(_near(tokens, strays, similarity, True), "nearest")
    both = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(both(met), "nearest-pairs")
    told = materialize(_aligned(pairs, texts_of(pairs), similarity), "alignments-nearest")
    edges, failed = told.where("same").select("u", "v"), told.where(~F.col("same"))
    missed = met.where("more").withColumns({"low": F.least("u", "v"), "high": F.greatest("u", "v")}).join(failed.select(F.col("u").alias("low"), F.col("v").alias("high")), ["low", "high"])
    missed = materialize(missed.select("u", "c"), "missed")
    if missed.isEmpty():
        return edges
    others = _near(tokens, materialize(missed.select(F.col("u").alias("rep")).distinct(), "missed-strays"), similarity, False)
    others = materialize(both(others.join(small(missed, 24), ["u", "c"], "leftsemi")).join(small(told.select("u", "v"), 24), ["u", "v"], "leftanti"), "others")
    return edges.union(materialize(_aligned(others, texts_of(others), similarity), "alignments-others").where("same").select("u", "v"))


def _links(keyed: DataFrame, bags: DataFrame, texts_of, similarity: float) -> DataFrame:
    """u, v: links that connect any two similar texts that share a bucket of keyed (key, rep); bags: rep, words, bag."""
    told, strays, rest = None, None, keyed
    while True:
        met = materialize(_candidates(rest), "bucket-pairs")
        pairs = met.select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct()
        pairs = materialize(_alike(pairs if told is None else pairs.join(told.select("u", "v"), ["u", "v"], "leftanti"), bags, similarity), "pairs")
        near = pairs.where("alike").select("u", "v")
        links = materialize(_verified(near, texts_of(near), similarity).union(pairs.where("not alike")), "alignments")
        told = links if told is None else told.union(links)
        failed = told.where(~F.col("same")).select(F.col("u").alias("lead"), F.col("v").alias("rep"))
        rest = materialize(met.join(failed, ["lead", "rep"]).select("key", "rep"), "failed")
        strays = rest if strays is None else strays
        n, linked = links.agg(F.count(F.lit(1)), F.count_if("same")).first()
        if linked * 4 < n or n == 0 or rest.isEmpty():
            break
    edges = told.where("same").select("u", "v")
    if strays.isEmpty():
        return edges
    # Two members that both linked with their bucket's leader are connected; every other pair has a member that failed with it.
    nodes = materialize(components(edges), "connected")
    hit = materialize(strays.select("key").distinct(), "stray-buckets")
    members = keyed.join(small(hit, 16), "key", "leftsemi").groupBy("rep").agg(F.collect_list("key").alias("tokens")).join(bags, "rep")
    members = members.join(nodes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    members = materialize(members.select("rep", "words", F.coalesce("component", "rep").alias("c"), "tokens", "bag"), "stray-members")
    return edges.union(_met(members, materialize(strays.select("rep").distinct(), "strays"), texts_of, similarity))


def near_groups(docs: DataFrame, similarity: float = 0.8, k: int = 5, sketches: int = 72, picks: int = 2, row_col: str | None = None) -> DataFrame:
    """doc_id, component_id, group_size, kept (and row, if row_col names a unique row number): one row per row of docs."""
    with small_batches(docs.sparkSession):  # all that runs Python is written within
        return _near_groups(docs, similarity, k, sketches, picks, row_col)


def _near_groups(docs: DataFrame, similarity: float, k: int, sketches: int, picks: int, row_col: str | None) -> DataFrame:
    rows = materialize(sketched(docs, k, sketches, picks, row_col), "order-minhash")
    worded = rows.where(F.size("keys") > 0)
    classes = materialize(worded.groupBy("digest").agg(F.min("row").alias("rep")), "text-classes")
    reps = worded.join(small(classes.select(F.col("rep").alias("row")), 16), "row", "leftsemi")
    keyed = reps.select(F.col("row").alias("rep"), F.explode("keys").alias("key"))  # read again from the written sketches, which take half the room
    bags = rows.select(F.col("row").alias("rep"), "words", "bag")
    edges = _links(keyed, bags, lambda pairs: _texts(docs, classes, pairs), similarity)
    of = classes.join(components(edges), F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("c"))
    told = materialize(worded.select("row", "doc_id", "digest").join(of, "digest"), "near-classes")
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "digest", "row"))
    groups = told.groupBy("c").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
    groups = materialize(groups.select("c", F.col("n").alias("group_size"), F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("stays")), "groups")
    in_group = F.col("stays").isNotNull()
    out = told.join(small(groups, 40), "c", "left").select(
        "doc_id", F.when(in_group, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (~in_group | (F.col("row") == F.col("stays"))).alias("kept"), "row",
    )
    alone = rows.where(F.size("keys") == 0).select("doc_id", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "row")
    return out.union(alone) if row_col else out.union(alone).drop("row")


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the classes that occur in pairs, by the class's number (rep)."""
    wanted = pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).distinct().join(classes, "rep")
    wanted = materialize(wanted, "wanted")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    return materialize(rows.join(small(wanted, 110), "digest").groupBy("rep").agg(F.max("text").alias("text")), "texts")
