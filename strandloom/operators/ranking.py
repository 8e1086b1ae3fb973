"""Global order without a global task.

``row_number`` and running sums over a whole table would bring it to one task. Here rows are ranked inside buckets
of an integer key, and the buckets' totals, one row each, are summed in order and added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 14


def _offsets(sums: DataFrame, part: list[str]) -> DataFrame:
    order = Window.partitionBy(*part) if part else Window
    before = order.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*part, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))


def global_rank(df: DataFrame, key: str, ties: list[str], name: str, part: list[str] | None = None, width: int = BUCKET) -> DataFrame:
    """Adds the rank from 0 by ``key`` (a non-negative integer), then ``ties``, over the table or each part of it."""
    part = part or []
    b = df.withColumn("_bucket", F.floor(F.col(key) / width).cast("long"))
    before = _offsets(b.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_sum")), part)
    inside = F.row_number().over(Window.partitionBy(*part, "_bucket").orderBy(key, *ties))
    return b.withColumn("_n", inside).join(before, [*part, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_bucket", "_before", "_n").select(*df.columns, name)


def running_sum(df: DataFrame, key: str, value: Column, name: str, part: list[str] | None = None, width: int = BUCKET) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row, in order of the unique integer ``key``."""
    part = part or []
    b = df.withColumns({"_bucket": F.floor(F.col(key) / width).cast("long"), "_v": value})
    before = _offsets(b.groupBy(*part, "_bucket").agg(F.sum("_v").alias("_sum")), part)
    inside = F.sum("_v").over(Window.partitionBy(*part, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return b.withColumn("_s", inside).join(before, [*part, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_s")).cast("long")).select(*df.columns, name)


def running_max_before(df: DataFrame, key: str, ties: list[str], value: Column, name: str, width: int = BUCKET) -> DataFrame:
    """Adds the greatest ``value`` of the rows before each in order of ``key`` and ``ties``, null for the first."""
    b = df.withColumns({"_bucket": F.floor(F.col(key) / width).cast("long"), "_v": value})
    tops = b.groupBy("_bucket").agg(F.max("_v").alias("_top"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select("_bucket", F.max("_top").over(before.orderBy("_bucket")).alias("_earlier"))  # one row per bucket
    inside = F.max("_v").over(before.partitionBy("_bucket").orderBy(key, *ties))
    return b.withColumn("_in", inside).join(earlier, "_bucket").withColumn(name, F.greatest("_earlier", "_in")).select(*df.columns, name)


def previous_value(df: DataFrame, rank: str, value: str, name: str, part: list[str] | None = None, width: int = BUCKET) -> DataFrame:
    """Adds the value at the rank before, null for the first, by windows inside buckets of ranks."""
    part = part or []
    b = df.withColumn("_bucket", F.floor(F.col(rank) / width).cast("long"))
    last = b.where(F.pmod(F.col(rank), F.lit(width)) == width - 1).select(*part, (F.col("_bucket") + 1).alias("_bucket"), F.col(value).alias("_last"))
    inside = F.lag(value).over(Window.partitionBy(*part, "_bucket").orderBy(rank))
    return b.withColumn("_lag", inside).join(last, [*part, "_bucket"], "left").withColumn(name, F.when(F.pmod(F.col(rank), F.lit(width)) == 0, F.col("_last")).otherwise(F.col("_lag"))).select(*df.columns, name)


def asof(probes: DataFrame, probe: str, rows: DataFrame, key: str, ident: str, name: str, width: int = 4096) -> DataFrame:
    """Adds to each probe the row with the greatest key at most the probe's (then the greatest id), or null.

    Probes and rows of a bucket are passed once, in order of their keys, and nothing is paired; if no row of its own
    bucket is early enough, the last row of the buckets before is a probe's.
    """
    found = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(ident).alias("_i"))
    r = found.select(F.floor(F.col("_k") / width).alias("_bucket"), "_k", F.lit(0).alias("_side"), F.struct("_k", "_i").alias("_r"), F.lit(None).cast(probes.select(F.struct("*").alias("p")).schema["p"].dataType).alias("_p"))
    p = probes.select(F.floor(F.col(probe) / width).alias("_bucket"), F.col(probe).alias("_k"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_p"))
    both = r.unionByName(p)
    tops = both.groupBy("_bucket").agg(F.max("_r").alias("_top"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    earlier = tops.select("_bucket", F.max("_top").over(before).alias("_earlier"))
    upto = Window.partitionBy("_bucket").orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_here", F.last("_r", ignorenulls=True).over(upto)).where("_side = 1")
    return here.join(earlier, "_bucket", "left").select("_p.*", F.coalesce("_here._i", "_earlier._i").alias(name))
