"""Per-call and per-sequence expressions. Allele codes are 0..13; 14 is a rare state, 15 missing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, RARE = 15, 14
#: Letters of the allele codes 0..5 and of unordered pairs.
LETTERS = ["A", "C", "G", "T", "+", "-"]
IUPAC = {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M", "+-": "0"}


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack(a1="a1", a2="a2") -> Column:
    """One byte value per call: the first allele in the high half."""
    return F.shiftleft(c(a1), 4).bitwiseOR(c(a2))


def unpack(call="call") -> tuple[Column, Column]:
    return F.shiftright(c(call), 4).bitwiseAND(15), c(call).bitwiseAND(15)


def unphased(a1="a1", a2="a2") -> Column:
    """The call with the smaller allele first."""
    return pack(F.least(c(a1), c(a2)), F.greatest(c(a1), c(a2)))


def is_missing(a1="a1", a2="a2") -> Column:
    return (c(a1) == MISSING) & (c(a2) == MISSING)


def is_het(a1="a1", a2="a2") -> Column:
    return c(a1) != c(a2)


def equal(x1, x2, y1, y2) -> Column:
    return unphased(x1, x2) == unphased(y1, y2)


def equal_or_unknown(x1, x2, y1, y2) -> Column:
    return is_missing(x1, x2) | is_missing(y1, y2) | equal(x1, x2, y1, y2)


def partially_equal(x1, x2, y1, y2) -> Column:
    return (c(x1) == c(y1)) | (c(x1) == c(y2)) | (c(x2) == c(y1)) | (c(x2) == c(y2))


def letter(allele) -> Column:
    return F.when(c(allele) < len(LETTERS), F.get(F.array(*map(F.lit, LETTERS)), c(allele))).otherwise("N")


def iupac(a1="a1", a2="a2") -> Column:
    """One letter per call; N for what has none."""
    pair = F.concat(F.least(letter(a1), letter(a2)), F.greatest(letter(a1), letter(a2)))
    mixed = reduce(lambda w, kv: w.when(pair == kv[0], kv[1]), list(IUPAC.items())[1:], F.when(pair == "AG", "R"))
    return F.when(c(a1) == c(a2), letter(a1)).otherwise(F.coalesce(mixed, F.lit("N")))


def alleles_of_iupac(x) -> tuple[Column, Column]:
    """(a1, a2) of a one-letter call; anything unknown is missing."""
    codes = {v: i for i, v in enumerate(LETTERS)}
    first = reduce(lambda w, kv: w.when(c(x) == kv[0], kv[1]), codes.items(), F.when(F.lit(False), 0))
    second = first
    for pair, one in IUPAC.items():
        first, second = first.when(c(x) == one, codes[pair[0]]), second.when(c(x) == one, codes[pair[1]])
    return first.otherwise(MISSING).cast("int"), second.otherwise(MISSING).cast("int")


def complement(x) -> Column:
    return F.translate(c(x), "ACGTRYKM", "TGCAYRMK")


def reverse_complement(x) -> Column:
    return F.reverse(complement(x))


def first_low_quality(quality, least: int, offset: int = 33) -> Column:
    """0-based place of the first base under the least quality, or the length."""
    low = F.regexp_instr(c(quality), F.lit(f"[\\x{offset:02x}-\\x{offset + least - 1:02x}]")) if least > 0 else F.lit(0)
    return F.when(low > 0, low - 1).otherwise(F.length(c(quality)))


def mismatches(a, b) -> Column:
    """Places where two sequences of one length differ."""
    return F.aggregate(F.sequence(F.lit(1), F.length(c(a))), F.lit(0), lambda n, i: n + (F.substring(c(a), i, F.lit(1)) != F.substring(c(b), i, F.lit(1))).cast("int"))


def bigrams(name) -> Column:
    s = F.upper(c(name))
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def pair_similarity(a, b) -> Column:
    """Dice similarity of two names' letter pairs as multisets; 0 where neither has two letters."""
    x, y = bigrams(a), bigrams(b)
    times = lambda arr, v: F.size(F.filter(arr, lambda e: e == v))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, v: n + F.least(times(x, v), times(y, v)))
    return F.when(F.size(x) + F.size(y) > 0, F.lit(2.0) * common / (F.size(x) + F.size(y))).otherwise(0.0)


def presence_bits(states: Column, index: Column) -> Column:
    """Aggregate: one 64-bit word with a bit for each index (0..63) where the condition holds."""
    return F.coalesce(F.bit_or(F.when(states, F.call_function("shiftleft", F.lit(1).cast("long"), index.cast("int")))), F.lit(0).cast("long"))



def _once(x: Column, then) -> Column:
    """then(x), with x made once: what a lambda names from outside is made again for each element."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def packed_sequence(seq, bases: int = 31) -> Column:
    """Words of `bases` letters, two bits each (A C G T are 0 to 3); null where another letter occurs."""
    word = lambda s: lambda i: F.conv(F.substring(s, i, F.lit(bases)), 4, 10).cast("long")
    words = lambda s: F.transform(F.sequence(F.lit(1), F.length(s), F.lit(bases)), word(F.translate(s, "ACGT", "0123")))
    return _once(c(seq), lambda s: F.when(~s.rlike("[^ACGT]") & (F.length(s) > 0), words(s)))


def unpacked_sequence(words, length, bases: int = 31) -> Column:
    """The letters of packed words of a sequence of the given length."""
    digits = lambda w, n: F.right(F.concat(F.lit("0" * bases), F.conv(w.cast("string"), 10, 4)), n)
    whole = lambda n: F.transform(c(words), lambda w, i: digits(w, F.least(F.lit(bases), n - i * bases)))
    return F.translate(_once(c(length), lambda n: F.array_join(whole(n), "")), "0123", "ACGT")


def file_parts(path) -> tuple[Column, Column, Column]:
    """(folder, name, suffix) of a path."""
    name = F.regexp_extract(c(path), r"([^/]*)$", 1)
    return F.regexp_extract(c(path), r"^(.*)/[^/]*$", 1), name, F.regexp_extract(name, r"\.([^.]*)$", 1)


def nth_place(text, part: str, n: int) -> Column:
    """Place (from 1) at which part begins for the n-th time, 0 if it doesn't."""
    before = F.substring_index(c(text), part, n)
    return F.when(F.size(F.split(c(text), re.escape(part))) > n, F.length(before) + 1).otherwise(0)


def wrapped(text, width: int) -> Column:
    """Lines of at most width characters."""
    return F.array_join(F.regexp_extract_all(c(text), F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")


def model_criteria(rss, n, parameters) -> tuple[Column, Column, Column]:
    """(AIC, AICc, BIC) of a least-squares fit with so many parameters."""
    n, k = c(n), c(parameters)
    fit = n * F.log(c(rss) / n)
    return fit + 2 * k, fit + 2 * k + 2 * k * (k + 1) / (n - k - 1), fit + k * F.log(n)
