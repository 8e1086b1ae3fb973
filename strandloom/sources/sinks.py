"""Writers of decoded reads and of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_se(reads: DataFrame, path: str, order: list[str]) -> None:
    """One read per line in the order of the given columns."""
    reads.orderBy(*order).select("seq").write.mode("overwrite").text(path)


def write_pe(reads: DataFrame, path: str, pair_path: str, order: list[str]) -> None:
    """Two files whose i-th lines are mates."""
    for mate, p in ((0, path), (1, pair_path)):
        reads.where(F.col("mate") == mate).orderBy(*order).select("seq").write.mode("overwrite").text(p)


def write_ordered(reads: DataFrame, path: str, pair_path: str | None = None) -> None:
    """Original order, one file or two."""
    if pair_path is None:
        write_se(reads, path, ["read_id"])
    else:
        write_pe(reads, path, pair_path, ["pair_id"])


def write_division(reads: DataFrame, path: str) -> None:
    reads.select("read_id").orderBy("read_id").write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)
