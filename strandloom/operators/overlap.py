"""Duplicate chains, suffix/prefix overlaps and the descending greedy loop."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.store import checkpointed, discard

#: Open ends that one task may take: packed, about 700 MB at 100 bases.
TASK_ROWS = 8_000_000
#: Open ends that one shuffle may take: 1 GB at 100 bases.
PART_ROWS = 16_000_000
#: Symbols by the bits that they are packed in; others take eight.
ALPHABETS = {2: "ACGT", 3: "ACGTN"}
#: Of the rolling hash; any odd number.
MULTIPLIER = 0x9E3779B97F4A7C15


def duplicate_chain(reads: DataFrame, length: int | None = None) -> DataFrame:
    """read_id, next_id, overlap: reads of one sequence chained by id."""
    follow = F.lead("read_id").over(Window.partitionBy("seq").orderBy("read_id"))
    full = F.lit(length) if length else F.length("seq")
    return reads.select("read_id", follow.alias("next_id"), full.alias("overlap")).where("next_id IS NOT NULL")


def chain_ends(reads: DataFrame) -> DataFrame:
    """seq, head, tail of each group of equal reads: the head may get a predecessor, the tail a successor."""
    return reads.groupBy("seq").agg(F.min("read_id").alias("head"), F.max("read_id").alias("tail"))


def overlap_pairs(suffixes: DataFrame, prefixes: DataFrame, length: int, overlap: int) -> DataFrame:
    """One-to-one pairs of equal suffixes and prefixes of ``overlap`` bases, by rank of read_id in each key.

    Keys are hashed before the shuffle and compared as text after it; a read never follows itself.
    """
    skip = length - overlap

    def ranked(df: DataFrame, key) -> DataFrame:
        k = df.select("read_id", key.alias("k")).withColumn("h", F.xxhash64("k"))
        return k.withColumn("rn", F.row_number().over(Window.partitionBy("h", "k").orderBy("read_id")))

    s, p = ranked(suffixes, F.substr("seq", F.lit(skip + 1))), ranked(prefixes, F.substr("seq", F.lit(1), F.lit(overlap)))
    pairs = s.alias("s").join(p.alias("p"), ["h", "k", "rn"])
    return pairs.select(F.col("s.read_id").alias("read_id"), F.col("p.read_id").alias("next_id")).where("read_id <> next_id").withColumn("overlap", F.lit(overlap))


def rank_pairs(suffix_keys: np.ndarray, prefix_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of suffixes and prefixes of equal key and rank; those of a read with itself are among them."""
    keys, code = np.unique(np.concatenate([suffix_keys, prefix_keys]), return_inverse=True)
    sides = []
    for side in (code[: len(suffix_keys)], code[len(suffix_keys) :]):
        order = np.argsort(side, kind="stable")
        first = np.searchsorted(side[order], np.arange(len(keys)))
        rank = np.arange(len(order)) - first[side[order]]
        sides.append((order, side[order].astype(np.int64) << 32 | rank))
    _, i, j = np.intersect1d(sides[0][1], sides[1][1], assume_unique=True, return_indices=True)
    return sides[0][0][i], sides[1][0][j]


def packing(seq: Column, length: int, bits: int) -> list[Column]:
    """The read as longs, ``bits`` a symbol, from the first symbol down; what is left of the last long is zeros."""
    per = 64 // bits
    total = -(-length // per) * per
    if bits == 8:
        digits, base, size = F.rpad(F.hex(F.encode(seq, "ISO-8859-1")), 2 * total, "0"), 16, 2
    else:
        digits, base, size = F.rpad(F.translate(seq, ALPHABETS[bits], "01234"), total, "0"), 1 << bits, 1
    return [F.conv(F.substr(digits, F.lit(at * size + 1), F.lit(per * size)), base, -10).cast("long") for at in range(0, total, per)]


def suffix_key(words: list[Column], length: int, overlap: int, bits: int) -> list[Column]:
    """The last ``overlap`` symbols of a packed read, packed from the first of them."""
    per = 64 // bits
    skip, shift = divmod(length - overlap, per)
    out = []
    for at in range(skip, skip - (-overlap // per)):
        word = words[at]
        if shift:
            word = F.shiftleft(word, shift * bits)
            if per * bits < 64:
                word = word.bitwiseAND(F.lit((1 << per * bits) - 1))
            if at + 1 < len(words):
                word = word.bitwiseOR(F.shiftrightunsigned(words[at + 1], (per - shift) * bits))
        out.append(word)
    return out


def prefix_key(words: list[Column], overlap: int, bits: int) -> list[Column]:
    """The first ``overlap`` symbols of a packed read, packed."""
    per = 64 // bits
    whole, rest = divmod(overlap, per)
    out = words[:whole]
    if rest:
        mask = ((1 << rest * bits) - 1) << (per - rest) * bits
        out = [*out, words[whole].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))]
    return out


def packed_batch(ids: pa.Array, seq: pa.Array, length: int, bits: int) -> pa.RecordBatch:
    """read_id, odd (whether the read has a symbol outside ``ALPHABETS[bits]``) and the words of ``packing``, in arrays."""
    per, n = 64 // bits, len(seq)
    known = np.full(256, 255, np.uint8)
    known[np.frombuffer(ALPHABETS[bits].encode(), np.uint8)] = np.arange(len(ALPHABETS[bits]))
    seq = seq.cast(pa.large_string())
    offsets = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + n + 1]
    if not seq.null_count and (np.diff(offsets) == length).all():
        codes = known[np.frombuffer(seq.buffers()[2], np.uint8, n * length, offsets[0])].reshape(n, length) if n else np.zeros((0, length), np.uint8)
        odd = (codes == 255).any(1)
    else:
        texts = [(x or "").encode() for x in seq.to_pylist()]
        codes, odd = np.zeros((n, length), np.uint8), np.zeros(n, bool)
        for row, text in enumerate(texts):
            code = known[np.frombuffer(text, np.uint8)]
            odd[row] = (code == 255).any()
            codes[row, : min(length, len(code))] = code[:length]
    missing = seq.is_null().to_numpy(zero_copy_only=False)
    words = []
    for at in range(0, length, per):
        word = np.zeros(n, np.uint64)
        for k in range(at, min(at + per, length)):
            word |= (codes[:, k] & np.uint8((1 << bits) - 1)).astype(np.uint64) << np.uint64((per - 1 - k + at) * bits)
        words.append(pa.array(word.view(np.int64), mask=missing))
    return pa.RecordBatch.from_arrays([ids, pa.array(odd, mask=missing), *words], names=["read_id", "odd", *[f"w{k}" for k in range(len(words))]])


def packed_reads(reads: DataFrame, length: int, bits: int) -> DataFrame:
    """read_id, odd, w0, w1, ...: arrays do it instead of expressions on text, which take what is in no alphabet."""
    n = -(-length // (64 // bits))
    if bits == 8:
        reads = reads.select(F.inline(F.array(F.struct("read_id", "seq"))))  # else each word would make the read's text again
        return reads.select("read_id", F.lit(False).alias("odd"), *[w.alias(f"w{k}") for k, w in enumerate(packing(F.col("seq"), length, bits))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield packed_batch(b.column(0), b.column(1), length, bits)

    return reads.select(F.col("read_id").cast("long").alias("read_id"), "seq").mapInArrow(run, ", ".join(["read_id long", "odd boolean", *[f"w{k} long" for k in range(n)]]))


def packed_ends(reads: DataFrame, length: int) -> tuple[DataFrame, int]:
    """read_id, next_id (the next equal read), first (whether no equal read is before) and the packed text w0, w1, ...

    Also the bits of a symbol: two, unless a read has others than ACGT.
    """
    for bits in (2, 3, 8):
        rows = packed_reads(reads, length, bits)
        names = [c for c in rows.columns if c.startswith("w")]
        same = Window.partitionBy(*names).orderBy("read_id")
        ends = checkpointed(rows.select("read_id", F.lead("read_id").over(same).alias("next_id"), F.lag("read_id").over(same).isNull().alias("first"), "odd", *names), "ends")
        if not ends.where("odd").limit(1).count():
            break
        discard(ends)
    return ends, bits


def paired(state: DataFrame, length: int, overlap: int, bits: int, parts: int, part: int) -> DataFrame:
    """Adds ``mate`` to open ends (side 0: suffixes, 1: prefixes) of a part of the keys: what overlap_pairs does, in one shuffle."""
    words = [c for c in state.columns if c.startswith("w")]
    both = zip(suffix_key([F.col(w) for w in words], length, overlap, bits), prefix_key([F.col(w) for w in words], overlap, bits), strict=True)
    keys = [F.when(F.col("side") == 0, a).otherwise(b) for a, b in both]
    names = [f"k{i}" for i in range(len(keys))]
    hashed = state.withColumn("h", F.xxhash64(*keys))
    mine = hashed if parts == 1 else hashed.where(F.pmod("h", F.lit(parts)) == part)
    dealt = mine.repartition("h").withColumns(dict(zip(names, keys, strict=True)))
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("h", *names, "side").orderBy("read_id")))
    meet = Window.partitionBy("h", *names, "rn").orderBy("side")
    mate = F.when(F.col("side") == 0, F.lead("read_id").over(meet)).otherwise(F.lag("read_id").over(meet))
    return ranked.withColumn("mate", mate).select("side", "read_id", *words, F.when(F.col("mate") != F.col("read_id"), F.col("mate")).alias("mate"))


def rolling_links(codes: list[np.ndarray], ids: np.ndarray, suffixes: np.ndarray, prefixes: np.ndarray, first: int, min_overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Read ids paired at each overlap from ``first`` down. ``codes`` has an array of symbols for each place of a read.

    Keys are rolling hashes. Texts of pairs are compared: if all are equal, pairs are those of the texts, since a hash
    leaves over ends of one side only; else the step is done with texts.
    """
    length = len(codes)
    rng = np.random.default_rng(1)
    value = rng.integers(0, 1 << 63, 256, np.uint64)
    powers = [1]
    for _ in range(length):
        powers.append(powers[-1] * MULTIPLIER % (1 << 64))
    inverse = np.uint64(pow(MULTIPLIER, -1, 1 << 64))
    power = [np.uint64(x) for x in powers]
    a, b = suffixes, prefixes
    s, p = np.zeros(len(a), np.uint64), np.zeros(len(b), np.uint64)
    for i in range(first):
        s += value[codes[length - first + i][a]] * power[i]
        p += value[codes[i][b]] * power[i]
    for overlap in range(first, min_overlap - 1, -1):
        if not len(a) or not len(b):
            return
        # most ends meet nothing: those whose hash's top bits the other side does not have are set aside
        top = np.uint64(64 - min(26, max(20, max(len(a), len(b)).bit_length() + 4)))
        seen = np.zeros(1 << 64 - int(top), bool)
        seen[p >> top] = True
        i = np.flatnonzero(seen[s >> top])
        seen[:] = False
        seen[s[i] >> top] = True
        j = np.flatnonzero(seen[p >> top])
        del seen
        x, y = rank_pairs(s[i], p[j])
        if any((codes[length - overlap + k][a[i[x]]] != codes[k][b[j[y]]]).any() for k in range(overlap)):
            text = lambda rows, at: np.ascontiguousarray(np.stack([codes[at + k][rows] for k in range(overlap)], 1)).view(f"V{overlap}")[:, 0]
            i, j = np.arange(len(a)), np.arange(len(b))
            known: dict[bytes, int] = {}
            left, right = (np.fromiter((known.setdefault(v.tobytes(), len(known)) for v in side), np.int64, len(side)) for side in (text(a, length - overlap), text(b, 0)))
            x, y = rank_pairs(left, right)
        i, j = i[x], j[y]
        other = np.flatnonzero(ids[a[i]] != ids[b[j]])
        other = other[np.argsort(i[other])]  # by the left end, whatever the hashes are
        i, j = i[other], j[other]
        if len(i):
            yield ids[a[i]], ids[b[j]], overlap
            a, s, b, p = np.delete(a, i), np.delete(s, i), np.delete(b, j), np.delete(p, j)
        s = (s - value[codes[length - overlap][a]]) * inverse
        p = p - value[codes[overlap - 1][b]] * power[overlap - 1]


class Symbols:
    """The symbols at one place of packed reads."""

    def __init__(self, word: np.ndarray, shift: np.uint64, mask: np.uint64):
        self.word, self.shift, self.mask = word, shift, mask

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return (self.word[rows] >> self.shift & self.mask).astype(np.uint8)


def finish_links(state: DataFrame, length: int, first: int, min_overlap: int, bits: int) -> DataFrame:
    """The steps from overlap ``first`` on in one task; for tables of a checked size only."""
    per = 64 // bits
    words = [c for c in state.columns if c.startswith("w")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(2 + len(words))]
        for b in batches:
            for column, values in zip(held, b.columns, strict=True):
                column.append(values.to_numpy(zero_copy_only=False).copy())  # else each column would hold its whole batch
        if not sum(map(len, held[0])):
            return
        side, ids = np.concatenate(held[0]), np.concatenate(held[1])
        held[0], held[1] = [], []
        order = np.argsort(ids, kind="stable")
        side, ids, packed = side[order], ids[order], []
        for k in range(len(words)):
            packed.append(np.concatenate(held[2 + k]).view(np.uint64)[order])
            held[2 + k] = []
        del order
        codes = [Symbols(packed[at // per], np.uint64((per - 1 - at % per) * bits), np.uint64((1 << bits) - 1)) for at in range(length)]
        for left, right, overlap in rolling_links(codes, ids, np.flatnonzero(side == 0), np.flatnonzero(side == 1), first, min_overlap):
            for at in range(0, len(left), 1 << 16):
                x, y = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), overlap, np.int32))], names=["read_id", "next_id", "overlap"])

    return state.select("side", "read_id", *words).repartition(1).mapInArrow(run, "read_id long, next_id long, overlap int")


def greedy_links(reads: DataFrame, length: int, min_overlap: int, task_rows: int = TASK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Links of the descending greedy: duplicates first, then overlaps from length-1 down to ``min_overlap``.

    Each step pairs only suffixes and prefixes that are still open; leftovers of a key whose pair was a read with
    itself stay open. Every step writes its links and the ends that it leaves open, and the ends before it are deleted.
    Steps are distributed, by parts of at most about ``part_rows`` ends to bound their shuffles, while more than
    ``task_rows`` ends are open; the rest is done in one task, in arrays.
    """
    ends, bits = packed_ends(reads, length)
    words = [c for c in ends.columns if c.startswith("w")]
    links = ends.where("next_id IS NOT NULL").select("read_id", "next_id", F.lit(length).alias("overlap"))
    found = [checkpointed(links, "found")]
    side = lambda k, which: ends.where(which).select(F.lit(k).cast("byte").alias("side"), "read_id", *words)
    state, steps = side(0, "next_id IS NULL").unionByName(side(1, "first")), [[ends]]
    for overlap in range(length - 1, min_overlap - 1, -1):
        n = state.count()
        if n <= task_rows:
            found.append(checkpointed(finish_links(state, length, overlap, min_overlap, bits), "found"))
            break
        parts, wrote = -(-n // part_rows), []
        for part in range(parts):
            # a key is whole in its part
            cut = paired(state, length, overlap, bits, parts, part)
            open_ = F.col("mate").isNull()
            kept = cut.where(open_ | (F.col("side") == 0)).select("side", "read_id", "mate", *[F.when(open_, F.col(w)).alias(w) for w in words], open_.alias("open"))
            wrote.append(checkpointed(kept, "step", "open"))
        discard(*steps[-1], part="open=true" if len(steps) > 1 else "")
        steps.append(wrote)
        both = reduce(DataFrame.unionByName, wrote)
        found.append(both.where("NOT open").select("read_id", F.col("mate").alias("next_id"), F.lit(overlap).alias("overlap")))
        state = both.where("open").select("side", "read_id", *words)
    out = checkpointed(reduce(DataFrame.unionByName, found), "greedy")
    discard(*sum(steps, []), *found)
    return out
