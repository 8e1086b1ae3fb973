"""Quality division of a stream of reads: stateless, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.classify import classify

SCHEMA = "read_id long, pair_id long, mate int, seq string, qual string"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def classified_stream(stream: DataFrame, err: float = 0.12) -> DataFrame:
    return classify(stream, err)
