"""k-mer occurrence queries and k-mer counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import kmers


def reads_containing(reads: DataFrame, kmer: str) -> DataFrame:
    return reads.where(F.contains("seq", F.lit(kmer))).select("read_id")


def occurrences(reads: DataFrame, kmer: str) -> DataFrame:
    """read_id, off of each occurrence; positions are made only for reads that contain the k-mer."""
    k = len(kmer)
    at = F.filter(F.sequence(F.lit(0), F.length("seq") - k), lambda i: F.substr("seq", i + 1, F.lit(k)) == kmer)
    return reads.where(F.contains("seq", F.lit(kmer))).select("read_id", F.length("seq").alias("_length"), F.explode(at).alias("off"))


def flat_occurrences(reads: DataFrame, kmer: str) -> DataFrame:
    return occurrences(reads, kmer).select((F.col("read_id") * F.col("_length") + F.col("off")).alias("flat"))


def single_occurrences(reads: DataFrame, kmer: str) -> DataFrame:
    """read_id, off for reads in which the k-mer occurs once; decided inside the row."""
    k = len(kmer)
    at = F.filter(F.sequence(F.lit(0), F.length("seq") - k), lambda i: F.substr("seq", i + 1, F.lit(k)) == kmer)
    found = reads.where(F.contains("seq", F.lit(kmer))).select("read_id", F.length("seq").alias("_length"), at.alias("_at")).where(F.size("_at") == 1)
    return found.select("read_id", "_length", F.col("_at")[0].alias("off"))


def repeats_inside(reads: np.ndarray, k: int) -> np.ndarray:
    """Which rows of a matrix of bytes hold some stretch of ``k`` twice; stretches are ranked by doubling, so this is exact."""
    n, length = reads.shape
    if length <= k:
        return np.zeros(n, bool)
    alphabet, code = np.unique(reads, return_inverse=True)
    code, base, width = code.reshape(n, length).astype(np.int64), max(2, len(alphabet)), 1
    while width < k:  # numbers of stretches of twice the width, or of k by two that overlap
        if base * base >= 1 << 62:
            known, code = np.unique(code, return_inverse=True)
            code, base = code.reshape(n, -1), max(2, len(known))
        step = min(width, k - width)
        code = code[:, : code.shape[1] - step] * base + code[:, step:]
        base, width = base * base, width + step
    code = np.sort(code, axis=1)
    return (code[:, 1:] == code[:, :-1]).any(1)


def repeated_kmer_reads(reads: DataFrame, k: int = 11) -> DataFrame:
    """Reads in which some k-mer occurs twice; decided in arrays of reads of one length, without exploding k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
            for length in np.unique(size[size > k]).tolist():
                rows = b.take(pa.array(np.flatnonzero(size == length)))
                bases = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(-1, length)
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(repeats_inside(bases, k)))], names=["read_id"])

    return reads.select("read_id", F.col("seq").cast("binary").alias("seq")).mapInArrow(run, "read_id long")


def kmer_counts(positions: DataFrame, k: int) -> DataFrame:
    """kmer, n and the running total before it, in order of k-mers; one row per k-mer reaches the window."""
    counts = positions.groupBy(F.substr("txt", F.lit(1), F.lit(k)).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    first = F.substr("kmer", F.lit(1), F.lit(2))
    inside = Window.partitionBy("_p").orderBy("kmer").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(first.alias("_p")).agg(F.sum("n").alias("_t"))
    before = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most 25 rows
    return counts.withColumn("_p", first).withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "_p").select("kmer", "n", (F.col("_before") + F.col("_in")).cast("long").alias("start"))


def capped_buckets(positions: DataFrame, k: int, cap: int = 13) -> DataFrame:
    """pos and kmer of at most ``cap`` first positions of each k-mer."""
    rows = positions.select("pos", F.substr("txt", F.lit(1), F.lit(k)).alias("kmer"))
    rank = F.row_number().over(Window.partitionBy("kmer").orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= cap)
