"""Sequence expressions: Column in, Column out. Only the means of quality scores leave the JVM, in Arrow batches: one pass
over the bytes is quicker than a pass per score inside generated code.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of IUPAC codes, fixed values; U pairs like T, and lower case becomes upper case.
IUPAC = "ACGTUNRYSWKMBDHV"
IUPAC_COMPLEMENT = "TGCAANYRSWMKVHDB"
BASE_ORDER = "ACGTN"
#: Hexadecimal digit of each base with one bit of its own, so that equal bases share a bit and N shares none.
ONE_HOT = {"A": "1", "C": "2", "G": "4", "T": "8", "N": "0"}
LANE = 15  # digits that fit a signed 64-bit number


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(F.upper(seq)), IUPAC, IUPAC_COMPLEMENT)


def symbol_value(symbol: Column, order: str = BASE_ORDER) -> Column:
    return F.instr(F.lit(order), symbol) - 1


def value_symbol(value: Column, order: str = BASE_ORDER) -> Column:
    return F.substr(F.lit(order), value.cast("int") + 1, F.lit(1))


def mismatch_code(actual: Column, mismatch: Column, order: str = BASE_ORDER) -> Column:
    """0..3: the mismatching base's value among the values that differ from the actual one."""
    a, m = symbol_value(actual, order), symbol_value(mismatch, order)
    return m - (m > a).cast("int")


def code_mismatch(actual: Column, code: Column, order: str = BASE_ORDER) -> Column:
    return value_symbol(code + (code >= symbol_value(actual, order)).cast("int"), order)


def context_code(actual: Column, mismatch: Column) -> Column:
    return F.shiftleft(symbol_value(actual), 4) + symbol_value(mismatch)


def phred_correct(score: int) -> float:
    """P(base is right) of a Phred score: 0 at 0, 1 from 41 on."""
    return 0.0 if score <= 0 else 1.0 if score >= 41 else 1 - 10 ** (-score / 10)


def count_of(text: Column, symbol: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))


def _score_means(strings: pd.Series, table: np.ndarray) -> pd.Series:
    """The mean of ``table`` over the bytes of each string, null for none: one pass over all bytes of a batch."""
    raw = [x.encode("latin-1", "replace") if x else b"" for x in strings]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    some = sizes > 0
    out = np.full(len(raw), np.nan)
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(table[np.frombuffer(b"".join(raw), np.uint8)], starts) / sizes[some]
    return pd.Series(out).astype(object).where(some, None)


def mean_correct(qual: Column, window: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Arithmetic mean of P(correct) over a window of the read, as fractions of its length; null for no quality."""
    part = qual
    if window != (0.0, 1.0):
        lo, hi = (F.floor(F.length(qual) * x).cast("int") for x in window)
        part = F.substr(qual, lo + 1, hi - lo)
    table = np.array([phred_correct(q - 33) for q in range(256)])

    @F.pandas_udf("double")
    def mean(strings: pd.Series) -> pd.Series:
        return _score_means(strings, table)

    return mean(part)


def geometric_correct(qual: Column) -> Column:
    """Geometric mean of P(correct); zero where a score is zero."""
    table = np.array([math.log(p) if (p := phred_correct(q - 33)) else -math.inf for q in range(256)])

    @F.pandas_udf("double")
    def mean(strings: pd.Series) -> pd.Series:
        return _score_means(strings, table)

    return F.exp(mean(qual))


def lanes(seq: Column, length: int) -> list[Column]:
    """The read as 64-bit numbers of one-hot nibbles."""
    digits = F.translate(seq, "".join(ONE_HOT), "".join(ONE_HOT.values()))
    return [F.conv(F.substr(digits, F.lit(at + 1), F.lit(min(LANE, length - at))), 16, 10).cast("long") for at in range(0, length, LANE)]


def matches(a: list[Column], b: list[Column]) -> Column:
    """Equal bases of two reads given as lanes; Hamming distance is length minus this."""
    return sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseAND(b[0])))


def hamming(a: Column, b: Column, cap: int | None = None) -> Column:
    """Differing positions of two strings of one length, any symbols."""
    n = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda acc, i: acc + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))
    return F.least(n, F.lit(cap)) if cap is not None else n


def mismatches(read: Column, text: Column) -> Column:
    """Array of (off, ref, alt) where the read differs from the text, offsets from 0."""
    at = F.filter(F.sequence(F.lit(1), F.length(read)), lambda i: F.substr(read, i, F.lit(1)) != F.substr(text, i, F.lit(1)))
    return F.transform(at, lambda i: F.struct((i - 1).alias("off"), F.substr(text, i, F.lit(1)).alias("ref"), F.substr(read, i, F.lit(1)).alias("alt")))


def apply_mismatches(text: Column, mis: Column) -> Column:
    return F.aggregate(mis, text, lambda acc, m: F.overlay(acc, m["alt"], m["off"] + 1, F.lit(1)))


def reverse_offsets(offsets: Column, length: Column) -> Column:
    """Gaps from the read's end to the last mismatch, then from each mismatch to the one before."""
    back = F.reverse(F.array_sort(offsets))
    return F.transform(back, lambda x, i: F.when(i == 0, length - 1 - x).otherwise(F.try_element_at(back, i) - x - 1))


def forward_offsets(gaps: Column, length: Column) -> Column:
    """Inverse of reverse_offsets."""
    start = F.struct(length.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(gaps, start, lambda acc, g: F.struct((acc["at"] - g - 1).cast("int").alias("at"), F.concat(F.array((acc["at"] - g - 1).cast("int")), acc["out"]).alias("out")))["out"]


def strided(seq: Column, step: int, first: int) -> Column:
    """Every ``step``-th symbol from ``first``, for a length that ``step`` divides."""
    return F.regexp_replace(seq, f"(?s).{{{first}}}(.).{{{step - 1 - first}}}", "$1")


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """Array of (off, kmer) at every ``step``-th offset."""
    last = F.length(seq) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.struct(i.alias("off"), F.substr(seq, i + 1, F.lit(k)).alias("kmer"))))


def varint_size(value: Column) -> Column:
    """Bytes of a number in 7-bit groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def bits(value: Column) -> Column:
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))


def sampling_steps(seed: int) -> tuple[int, int, int]:
    """K-mer length and two co-prime steps that together find each exact stretch of ``seed`` bases.

    Text k-mers are taken at multiples of the first step, read k-mers at multiples of the second; a stretch holds
    seed - K + 1 k-mers, so their product may be that at most.
    """
    known = {38: (28, 5, 2), 45: (32, 4, 3), 30: (24, 3, 2), 24: (20, 5, 1)}
    if seed in known:
        return known[seed]
    k = max(12, min(32, (seed * 3) // 4))
    room = seed - k + 1
    pairs = [(a, b) for a in range(1, room + 1) for b in range(1, a + 1) if a * b <= room and math.gcd(a, b) == 1]
    return (k, *max(pairs, key=lambda p: (p[0] * p[1], p[1])))


#: A codebook of base words for dictionary coding, all words of one to four bases in order of length, longest first.
def dna_words(longest: int = 3) -> list[str]:
    words, last = [], [""]
    for _ in range(longest):
        last = [w + b for w in last for b in "ACGT"]
        words = last + words
    return words


def tokenize_dna(seq: Column, words: list[str] | None = None) -> Column:
    """Greedy longest words from the left; other symbols stand alone."""
    return F.regexp_extract_all(seq, F.lit("(?s)" + "|".join([*(words or dna_words()), "."])), F.lit(0))
