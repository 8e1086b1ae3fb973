"""Aggregates over read sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import BASE_ORDER, bits, count_of


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def symbol_counts(reads: DataFrame, symbols: str = BASE_ORDER) -> DataFrame:
    """symbol, n over all reads; symbols are counted inside each row, nothing is exploded per base."""
    sums = reads.agg(*[F.sum(count_of(F.upper("seq"), s)).cast("long").alias(s) for s in symbols])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(s).alias("n")) for s in symbols])).alias("x")).select("x.*").where("n > 0")


def reads_profile(reads: DataFrame, symbols: str = BASE_ORDER) -> DataFrame:
    """One row: counts, lengths, whether the length is constant, and the symbols present in byte order."""
    n = F.length("seq")
    seen = [F.when(F.max(F.contains(F.upper("seq"), F.lit(s))), F.lit(s)).otherwise("") for s in sorted(symbols)]
    return reads.agg(
        F.count(F.lit(1)).alias("reads"), F.sum(n).cast("long").alias("total_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), (F.min(n) == F.max(n)).alias("constant"), F.concat(*seen).alias("symbols")
    )


def duplicate_count(reads: DataFrame) -> DataFrame:
    """Reads beyond the first of each sequence, by one aggregate per sequence."""
    return reads.groupBy("seq").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").cast("long").alias("duplicates"))


def pg_length(links: DataFrame, reads: DataFrame, length: int) -> DataFrame:
    """Length of the layout: each read adds what its link does not overlap."""
    n = reads.agg(F.count(F.lit(1)).alias("n"))
    saved = links.agg(F.coalesce(F.sum(F.least("overlap", F.lit(length))), F.lit(0)).alias("saved"))
    both = n.select(F.col("n") * length, F.lit(0)).toDF("total", "saved").unionByName(saved.select(F.lit(0).cast("long").alias("total"), "saved"))
    return both.agg((F.sum("total") - F.sum("saved")).cast("long").alias("pg_length"))


def component_counts(links: DataFrame, reads: DataFrame) -> DataFrame:
    """Components (a successor, no predecessor) and singles (neither)."""
    has_next, has_before = (links.select(F.col(c).alias("read_id")).distinct().withColumn(n, F.lit(1)) for c, n in (("read_id", "_n"), ("next_id", "_b")))
    both = reads.select("read_id").join(has_next, "read_id", "left").join(has_before, "read_id", "left")
    return both.agg(F.count_if(F.col("_n").isNotNull() & F.col("_b").isNull()).alias("components"), F.count_if(F.col("_n").isNull() & F.col("_b").isNull()).alias("singles"))


def stream_size(reads: DataFrame) -> DataFrame:
    """Bytes of the plain text: each read and a line end."""
    return reads.agg(F.sum(F.length("seq") + 1).cast("long").alias("bytes"))


def bits_estimate(values: DataFrame, column: str, width: int = 32) -> DataFrame:
    return values.agg((bits(F.max(column)) / width).alias("estimate"))


def entropy(values: DataFrame, column: str) -> DataFrame:
    """Order-0 entropy of a column in bits per value, the size an adaptive range coder tends to."""
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # n and the sum of n log n give it in one pass
    s = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l"))
    return s.select(F.round(F.log2("t") - F.col("l") / F.col("t"), 9).alias("entropy"))
