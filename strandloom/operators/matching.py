"""Mapping reads on a text, exactly and with bounded Hamming distance, on both strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import IUPAC, IUPAC_COMPLEMENT, kmers, lanes, matches, mismatches, reverse_complement, sampling_steps, strided
from strandloom.operators.layout import CHUNK, slice_reads
from strandloom.operators.store import checkpointed


def both_strands(reads: DataFrame) -> DataFrame:
    """read_id, seq, rc: each read as it is and reverse-complemented; the text stays as it is."""
    forward = reads.select("read_id", "seq", F.lit(False).alias("rc"))
    return forward.unionByName(reads.select("read_id", reverse_complement(F.col("seq")).alias("seq"), F.lit(True).alias("rc")))


def best(found: DataFrame) -> DataFrame:
    """The match of fewest mismatches, forward before reverse, then the first position."""
    b = found.groupBy("read_id").agg(F.min(F.struct("mis", "rc", "pos")).alias("b"))
    return b.select("read_id", F.col("b.pos").alias("pos"), F.col("b.rc").alias("rc"), F.col("b.mis").cast("int").alias("mis"))


def exact(reads: DataFrame, text: DataFrame) -> DataFrame:
    """Best exact match; ``text`` has pos and txt, one row for each position."""
    return best(both_strands(reads).join(text, F.col("seq") == F.col("txt")).select("read_id", "pos", "rc", F.lit(0).alias("mis")))


def exact_in_chunks(reads: DataFrame, chunks: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """What ``exact`` does, on a text given as overlapping chunks.

    Strands and positions meet by hash, so that no position's text is shuffled; pairs are then compared as text.
    """
    r = both_strands(reads).select("read_id", "rc", F.xxhash64("seq").alias("h"))
    last = F.least(F.lit(chunk - 1), F.length("seq") - length)  # a chunk's last length-1 places belong to the next, if there is one
    t = chunks.select("start", "seq", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("o"))
    t = t.select((F.col("start") + F.col("o")).alias("pos"), F.xxhash64(F.substr("seq", F.col("o") + 1, F.lit(length))).alias("h"))
    pairs = checkpointed(r.join(t, "h").select("read_id", "rc", "pos"), "pairs")
    text = F.when(F.col("rc"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    asked = pairs.join(reads.select("read_id", "seq"), "read_id").select("read_id", "rc", "pos", text.alias("asked"))
    return best(slice_reads(asked, chunks, length, chunk).where("slice = asked").select("read_id", "pos", "rc", F.lit(0).alias("mis")))


def verified(candidates: DataFrame, reads: DataFrame, text: DataFrame, length: int, most: int) -> DataFrame:
    """Candidates (read_id, rc, pos) whose Hamming distance is at most ``most``, with it as mis.

    Both sides come as 64-bit lanes of one-hot nibbles, made once per read and position.
    """
    r = reads.select("read_id", "rc", *[x.alias(f"a{i}") for i, x in enumerate(lanes(F.col("seq"), length))])
    t = text.select("pos", *[x.alias(f"b{i}") for i, x in enumerate(lanes(F.col("txt"), length))])
    n = range(-(-length // 15))
    joined = candidates.distinct().join(t, "pos").join(r, ["read_id", "rc"])
    mis = F.lit(length) - matches([F.col(f"a{i}") for i in n], [F.col(f"b{i}") for i in n])
    return joined.select("read_id", "rc", "pos", mis.alias("mis")).where(F.col("mis") <= most)


def seeded(reads: DataFrame, text: DataFrame, length: int, most: int, seed: int) -> DataFrame:
    """Pigeonhole: disjoint seeds of the read at stride ``seed`` meet equal stretches of the text."""
    both = both_strands(reads)
    keys = F.explode(kmers(F.substr("seq", F.lit(1), F.lit(length // seed * seed)), seed, seed))
    r = both.select("read_id", "rc", keys.alias("s")).select("read_id", "rc", F.col("s.off").alias("off"), F.col("s.kmer").alias("key"))
    t = text.select("pos", F.explode(F.sequence(F.lit(0), F.lit((length // seed - 1) * seed), F.lit(seed))).alias("off"), "txt")
    t = t.select("pos", "off", F.substr("txt", F.col("off") + 1, F.lit(seed)).alias("key"))
    found = r.join(t, ["off", "key"]).select("read_id", "rc", "pos")
    return best(verified(found, both, text, length, most))


def interleaved(reads: DataFrame, text: DataFrame, length: int, most: int, parts: int) -> DataFrame:
    """Seeds that take every ``parts``-th base, from each offset below ``parts``."""
    both = both_strands(reads)
    keys = lambda s: F.explode(F.array(*[F.struct(F.lit(j).alias("j"), strided(s, parts, j).alias("key")) for j in range(parts)]))
    r = both.select("read_id", "rc", keys(F.col("seq")).alias("s")).select("read_id", "rc", "s.*")
    t = text.select("pos", keys(F.col("txt")).alias("s")).select("pos", "s.*")
    return best(verified(r.join(t, ["j", "key"]).select("read_id", "rc", "pos"), both, text, length, most))


def sampled_candidates(both: DataFrame, text: DataFrame, k: int, read_step: int, cap: int | None) -> DataFrame:
    """read_id, rc, pos where a read's k-mer at a multiple of ``read_step`` meets one of ``text`` (at, key)."""
    r = both.select("read_id", "rc", F.explode(kmers(F.col("seq"), k, read_step)).alias("s")).select("read_id", "rc", "s.off", F.col("s.kmer").alias("key"))
    if cap is not None:
        from pyspark.sql import Window

        text = text.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("_n") <= cap).drop("_n")
    return r.join(text, "key").select("read_id", "rc", (F.col("at") - F.col("off")).alias("pos")).where("pos >= 0")


def sampled(reads: DataFrame, text: DataFrame, length: int, most: int, seed: int = 38, cap: int | None = None) -> DataFrame:
    """Co-prime sampling of both sides: text k-mers at one step, read k-mers at another."""
    k, text_step, read_step = sampling_steps(seed)
    both = both_strands(reads)
    t = text_kmers(text, k, length).where(F.col("at") % text_step == 0)
    return best(verified(sampled_candidates(both, t, k, read_step, cap), both, text, length, most))


#: Of the k-mers' hash: any odd number, and a number for each byte.
MULTIPLIER = 0x9E3779B97F4A7C15
VALUES = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64)


def complement_bytes() -> np.ndarray:
    """What ``reverse_complement`` makes of each byte."""
    upper = np.frombuffer(bytes(range(256)).upper(), np.uint8)
    table = np.arange(256, dtype=np.uint8)
    table[np.frombuffer(IUPAC.encode(), np.uint8)] = np.frombuffer(IUPAC_COMPLEMENT.encode(), np.uint8)
    return table[upper]


def symbols(seq: pa.Array, length: int) -> np.ndarray:
    """A row of bytes for each text; all have ``length`` bytes."""
    seq = seq.cast(pa.large_string())
    first = int(np.frombuffer(seq.buffers()[1], np.int64)[seq.offset])
    return np.frombuffer(seq.buffers()[2], np.uint8, len(seq) * length, first).reshape(len(seq), length)


def kmer_hashes(rows: np.ndarray, k: int, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the k-mer at each offset of each row, from differences of running sums."""
    n = rows.shape[1]
    ones = np.ones(1, np.uint64)
    powers, back = (np.cumprod(np.append(ones, np.full(n - 1, x, np.uint64))) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
    sums = np.zeros((len(rows), n + 1), np.uint64)
    np.cumsum(VALUES[rows] * powers, axis=1, out=sums[:, 1:])
    return (sums[:, offsets + k] - sums[:, offsets]) * back[offsets]


def hashed_kmers(reads: DataFrame, length: int, k: int, offsets: np.ndarray) -> DataFrame:
    """read_id, code (offset times two, one more on the reverse strand) and hash of the k-mers at some offsets of both strands."""
    complement = complement_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rows = symbols(part.column(1), length)
                ids = np.repeat(part.column(0).to_numpy(), len(offsets))
                for rc, strand in ((0, rows), (1, complement[rows[:, ::-1]])):
                    code = np.tile((2 * offsets + rc).astype(np.int32), len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(code), pa.array(kmer_hashes(strand, k, offsets).ravel().view(np.int64))], names=["read_id", "code", "h"])

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, code int, h long")


def hashed_text(chunks: DataFrame, k: int, step: int, chunk: int) -> DataFrame:
    """at, h of the k-mers at multiples of ``step`` of a text given as overlapping chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, found = b.slice(at, 64), []
                for start, seq in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = np.frombuffer(seq.encode(), np.uint8)
                    # a chunk's last length-1 places belong to the next, if there is one
                    offsets = np.arange(-start % step, min(chunk - 1, len(text) - k) + 1, step)
                    if len(offsets):
                        found.append((start + offsets, kmer_hashes(text[None], k, offsets)[0]))
                if found:
                    places, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(hashes.view(np.int64))], names=["at", "h"])

    return chunks.select(F.col("start").cast("long").alias("start"), "seq").mapInArrow(run, "at long, h long")


def compared(pairs: DataFrame, length: int, most: int, k: int, text_step: int, read_step: int) -> DataFrame:
    """Of (read_id, rc, pos, seq, slice) those with at most ``most`` mismatches, with them as mis, and with an equal sampled k-mer.

    As in ``lanes``, only A, C, G and T are equal to themselves; k-mers are equal as text.
    """
    complement, offsets = complement_bytes(), np.arange(0, length - k + 1, read_step)
    base = np.isin(np.arange(256), np.frombuffer(b"ACGT", np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rc, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            a, text = (symbols(b.column(c), length) for c in (3, 4))
            a = np.where(rc[:, None], complement[a[:, ::-1]], a)
            same = a == text
            mis = length - (same & base[a]).sum(1, dtype=np.int32)
            near = np.flatnonzero(mis <= most)
            runs = np.zeros((len(near), length + 1), np.int16)
            np.cumsum(same[near], axis=1, out=runs[:, 1:])
            whole = runs[:, offsets + k] - runs[:, offsets] == k
            keep = near[(whole & ((pos[near, None] + offsets) % text_step == 0)).any(1)]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep)) for c in range(3)] + [pa.array(mis[keep].astype(np.int32))], names=["read_id", "rc", "pos", "mis"])

    return pairs.select("read_id", "rc", "pos", "seq", "slice").mapInArrow(run, "read_id long, rc boolean, pos long, mis int")


def sampled_in_chunks(reads: DataFrame, chunks: DataFrame, length: int, most: int, seed: int = 38, cap: int | None = None, chunk: int = CHUNK, exact_only: bool = False) -> DataFrame:
    """What ``sampled`` does, on a text given as overlapping chunks: only sampled k-mers and candidates become rows.

    K-mers meet by 64-bit hashes; pairs are compared as text. With ``exact_only`` only matches without mismatches are
    found, those that ``sampled`` would find: of a read's k-mers the first text_step ones do, as they take each rest once.
    A cap keeps the k-mers as text.
    """
    k, text_step, read_step = sampling_steps(seed)
    reads = reads.where((F.length("seq") == length) & (F.octet_length("seq") == length)).select(F.col("read_id").cast("long").alias("read_id"), "seq")
    if length < k:
        return best(reads.limit(0).select("read_id", F.lit(False).alias("rc"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("mis")))
    if cap is None:
        last = min(length - k, (text_step - 1) * read_step) if exact_only else length - k
        r = hashed_kmers(reads, length, k, np.arange(0, last + 1, read_step))
        found = r.join(hashed_text(chunks, k, text_step, chunk), "h").select("read_id", (F.col("code") % 2 == 1).alias("rc"), (F.col("at") - F.shiftright("code", 1)).alias("pos")).where("pos >= 0")
        found = found if exact_only else found.distinct()
    else:
        first = F.pmod(-F.col("start"), F.lit(text_step))
        last_ = F.least(F.lit(chunk - 1), F.length("seq") - k)
        at = F.explode(F.when(first <= last_, F.sequence(first.cast("int"), last_.cast("int"), F.lit(text_step))))
        t = chunks.select("start", "seq", at.alias("o")).select((F.col("start") + F.col("o")).alias("at"), F.substr("seq", F.col("o") + 1, F.lit(k)).alias("key"))
        found = sampled_candidates(both_strands(reads), t, k, read_step, cap).distinct()
    pairs = slice_reads(found.join(reads.withColumnRenamed("seq", "own"), "read_id"), chunks, length, chunk).where(F.octet_length("slice") == length)
    return best(compared(pairs.select("read_id", "rc", F.col("pos").cast("long").alias("pos"), F.col("own").alias("seq"), "slice"), length, 0 if exact_only else most, k, text_step, read_step))


def text_kmers(text: DataFrame, k: int, length: int) -> DataFrame:
    """at, key of every k-mer of a text given as its stretches: each stretch's first, and those inside the last."""
    last = text.groupBy().agg(F.max(F.struct("pos", "txt")).alias("m")).select("m.*")  # one row
    tail = last.select(F.explode(F.sequence(F.lit(1), F.lit(length - k))).alias("j"), "pos", "txt").select((F.col("pos") + F.col("j")).alias("at"), F.substr("txt", F.col("j") + 1, F.lit(k)).alias("key"))
    return text.select(F.col("pos").alias("at"), F.substr("txt", F.lit(1), F.lit(k)).alias("key")).unionByName(tail)


def two_phase(reads: DataFrame, text: DataFrame, length: int, most: int, pre_seed: int, seed: int, floor: int = 0) -> DataFrame:
    """A strict pass first; only reads left above ``floor`` mismatches get the looser pass."""
    first = sampled(reads, text, length, most, pre_seed)
    rest = reads.join(first.where(F.col("mis") <= floor).select("read_id"), "read_id", "left_anti")
    return best(first.unionByName(sampled(rest, text, length, most, seed)).select("read_id", "pos", "rc", "mis"))


def match_histogram(reads: DataFrame, matched: DataFrame) -> DataFrame:
    """mis, n; unmatched reads under null."""
    return reads.select("read_id").join(matched.select("read_id", "mis"), "read_id", "left").groupBy("mis").agg(F.count(F.lit(1)).alias("n"))


def mismatch_rows(reads: DataFrame, matched: DataFrame, text: DataFrame) -> DataFrame:
    """read_id, rc, off, ref, alt of each mismatch, offsets on the text's strand."""
    m = matched.where("mis > 0").join(text, "pos").join(reads.select("read_id", "seq"), "read_id")
    seq: Column = F.when(F.col("rc"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return m.select("read_id", "rc", F.explode(mismatches(seq, F.col("txt"))).alias("m")).select("read_id", "rc", "m.*")


def mismatch_positions(rows: DataFrame, length: int) -> DataFrame:
    """off, n by position in the read; reverse matches mirrored."""
    return rows.select(F.when(F.col("rc"), length - 1 - F.col("off")).otherwise(F.col("off")).alias("off")).groupBy("off").agg(F.count(F.lit(1)).alias("n"))


def base_order(rows: DataFrame) -> DataFrame:
    """alt, n, rank: mismatching bases by falling frequency; at most five rows."""
    from pyspark.sql import Window

    counts = rows.groupBy("alt").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "alt")).cast("long"))


def maximal_matches(left: DataFrame, right: DataFrame, k: int, least: int) -> DataFrame:
    """src_pos, dest_pos, length of maximal equal stretches of two texts given as (at, key) of all their k-mers.

    Hits on one diagonal with consecutive positions are one stretch: islands of position minus rank.
    """
    from pyspark.sql import Window

    hits = left.select(F.col("at").alias("src"), "key").join(right.select(F.col("at").alias("dest"), "key"), "key").select("src", "dest", (F.col("src") - F.col("dest")).alias("diagonal"))
    island = F.col("dest") - F.row_number().over(Window.partitionBy("diagonal").orderBy("dest"))
    runs = hits.withColumn("island", island).groupBy("diagonal", "island").agg(F.min("src").alias("src_pos"), F.min("dest").alias("dest_pos"), (F.count(F.lit(1)) + k - 1).cast("long").alias("length"))
    return runs.where(F.col("length") >= least).select("src_pos", "dest_pos", "length")


def contained(reads: DataFrame, intervals: DataFrame, length: int, width: int = 4096) -> DataFrame:
    """read_id, src_pos, length: reads that lie inside an interval; both meet in bins of positions."""
    r = reads.withColumn("bin", F.floor(F.col("pos") / width))
    i = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("src_pos") / width), F.floor((F.col("src_pos") + F.col("length") - 1) / width))))
    inside = (F.col("pos") >= F.col("src_pos")) & (F.col("pos") + length <= F.col("src_pos") + F.col("length"))
    return r.join(i, "bin").where(inside).select("read_id", "src_pos", "length")
