"""Quality rules with suffix-array repetition.

Words are maximal runs of bytes other than space and U+0009 to U+000D. For a slice of documents one suffix
array over word codes is built by prefix doubling; codes are told apart by document, so that no repeat crosses
documents. Longest-common-prefix intervals give, for each word, the longest substring that starts there and
occurs again in its document. Those of at least ``min_repeat`` words are maximal repeated substrings; their
spans are united, and a document is kept if the united spans cover at most ``max_covered`` of its words and no
repeat is longer than ``max_longest`` words. The base rules (too few words, too many words in repeated 3-word
windows) come first.

Defined cases: a null or empty text has zero words, fails the base rules and is not kept; documents with one
id each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_arrow_batches, id_text, read_table, slices

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
_DROP_SYMBOLS = bytes(SYMBOLS)


def suffix_levels(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks by prefix doubling: the final ranks, and the rank arrays for prefixes of 1, 2, 4, ... codes.

    A suffix that is already alone in its group keeps its rank; only groups of two or more are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = first[group]
    active = np.sort(order[sizes[group] > 1])
    levels, h = [rank[:n].astype(np.int32)], 1
    while len(active):
        follow = rank[np.minimum(active + h, n)]
        key = rank[active] * (n + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        at, key = active[order], key[order]
        old = rank[at]
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = key[1:] != key[:-1]
        old_new = np.empty(len(at), bool)
        old_new[:1] = True
        old_new[1:] = old[1:] != old[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        old_first = np.flatnonzero(old_new)[np.cumsum(old_new) - 1]
        value = old + first[group] - old_first
        rank[at] = value
        sizes = np.diff(np.append(first, len(at)))
        active = np.sort(at[sizes[group] > 1])
        levels.append(rank[:n].astype(np.int32))
        h *= 2
    return rank[:n], levels


def repeat_lengths(codes: np.ndarray, least: int = 2) -> np.ndarray:
    """For each position, the most codes of a substring that starts there and occurs elsewhere too (0 below ``least``)."""
    n = len(codes)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    rank, levels = suffix_levels(codes)
    base = max(t for t in range(len(levels)) if 1 << t <= max(least, 1)) if levels else 0
    ranks = levels[base]
    members = np.bincount(ranks, minlength=n)[ranks] > 1
    at = np.flatnonzero(members)
    if not len(at):
        return out
    suffixes = at[np.argsort(rank[at], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    same = ranks[a] == ranks[b]
    lcp = np.zeros(len(a), np.int64)
    a, b, keep = a[same], b[same], np.flatnonzero(same)
    off = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        pa_, pb_ = a + off, b + off
        inside = (pa_ < n) & (pb_ < n)
        hit = np.zeros(len(a), bool)
        hit[inside] = levels[t][pa_[inside]] == levels[t][pb_[inside]]
        off[hit] += 1 << t
    lcp[keep] = off
    out[suffixes[:-1]] = lcp
    out[suffixes[1:]] = np.maximum(out[suffixes[1:]], lcp)
    out[out < least] = 0
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(SPACES):
            seen.add(line)
    return repeated


def rule_columns(texts: list[bytes], min_repeat: int, max_covered: float, max_longest: int) -> list[np.ndarray]:
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    codes, at = np.empty(total, np.int64), 0
    for w in words:
        seen: dict[bytes, int] = {}
        codes[at : at + len(w)] = np.fromiter(map(seen.setdefault, w, count(at)), np.int64, len(w))
        at += len(w)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    lengths = repeat_lengths(codes, 3)
    three = np.flatnonzero(lengths >= 3)
    repeat_words = np.bincount(owner[covered(three, np.full(len(three), 3), total)], minlength=len(texts))
    long = np.flatnonzero(lengths >= min_repeat)
    cover_words = np.bincount(owner[covered(long, lengths[long], total)], minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner[long], lengths[long])
    assert total == (ends[-1] if len(ends) else 0)
    chars = np.array([sum(map(len, w)) for w in words], np.int64)
    for k, t in enumerate(texts):
        if not t.isascii():
            chars[k] = sum(len(x.decode("utf-8", "replace")) for x in (t.translate(None, SPACES),))
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    lines = np.array([duplicate_lines(t) for t in texts], np.int64)
    failed = (sizes < 50) | (100 * repeat_words > 50 * sizes)
    kept = ~failed & (cover_words <= max_covered * sizes) & (longest <= max_longest)
    return [sizes, chars, symbols, lines, repeat_words.astype(np.int64), failed, kept, cover_words.astype(np.int64), longest]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 200) -> DataFrame:
    """One row per document with the rule counts, the base verdict and the verdict of the repetition rules."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for part in slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            columns = rule_columns(texts, min_repeat, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
