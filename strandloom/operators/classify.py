"""Quality predicates and the division of reads into HQ, LQ and N."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import mean_correct


def contains_n(seq: Column) -> Column:
    return F.contains(seq, F.lit("N"))


def suffix_quality(qual: Column, length: int | Column, err: float = 0.12) -> Column:
    """Whether the quality byte where the tolerated tail begins is above the lowest; no quality is high."""
    if isinstance(length, int):
        at: Column = F.lit(math.floor(length * (1 - err)) + 1)
    else:
        at = F.floor(length * (1 - err)).cast("int") + 1
    return F.coalesce(F.substr(qual, at, F.lit(1)) > "#", F.lit(True))


def mean_quality(qual: Column, err: float = 0.12) -> Column:
    return F.coalesce(1 - mean_correct(qual) <= err, F.lit(True))


def classify(reads: DataFrame, err: float = 0.12, suffix_mode: bool = True, separate_n: bool = True) -> DataFrame:
    """Adds class; the N test is first and cheapest, an error limit of one or more turns the quality test off."""
    good = F.lit(True) if err >= 1 else suffix_quality(F.col("qual"), F.length("seq"), err) if suffix_mode else mean_quality(F.col("qual"), err)
    other = F.when(good & ~contains_n(F.col("seq")), "HQ").otherwise("LQ")
    return reads.withColumn("class", F.when(contains_n(F.col("seq")), "N").otherwise(other) if separate_n else other)


def division(reads: DataFrame, ids: DataFrame, complement: bool = False) -> DataFrame:
    """Reads that are (or are not) in a table of read_id."""
    return reads.join(ids.select("read_id").distinct(), "read_id", "left_anti" if complement else "left_semi")


def reload_division(reads: DataFrame, lq_ids: DataFrame, n_ids: DataFrame, skip_hq: bool = False) -> DataFrame:
    lq, n = (x.select("read_id").distinct().withColumn(name, F.lit(True)) for x, name in ((lq_ids, "_lq"), (n_ids, "_n")))
    both = reads.join(n, "read_id", "left").join(lq, "read_id", "left")
    out = both.withColumn("class", F.when(F.col("_n"), "N").when(F.col("_lq"), "LQ").otherwise("HQ")).drop("_lq", "_n")
    return out.where("class <> 'HQ'") if skip_hq else out


def both_sides_overlapped(reads: DataFrame, links: DataFrame, length: int) -> DataFrame:
    """Reads with a predecessor and a successor, or in a duplicate link on either side."""
    out = links.groupBy(F.col("read_id")).agg(F.lit(True).alias("_next"), F.max(F.col("overlap") >= length).alias("_dup_next"))
    into = links.groupBy(F.col("next_id").alias("read_id")).agg(F.lit(True).alias("_before"), F.max(F.col("overlap") >= length).alias("_dup_before"))
    ids = out.join(into, "read_id", "full").where("(_next AND _before) OR coalesce(_dup_next, false) OR coalesce(_dup_before, false)")
    return reads.join(ids.select("read_id"), "read_id", "left_semi")


def demote(classified: DataFrame, good: DataFrame) -> DataFrame:
    """HQ reads that are not in ``good`` become LQ."""
    flag = good.select("read_id").distinct().withColumn("_good", F.lit(True))
    return classified.join(flag, "read_id", "left").withColumn("class", F.when((F.col("class") == "HQ") & F.col("_good").isNull(), "LQ").otherwise(F.col("class"))).drop("_good")
