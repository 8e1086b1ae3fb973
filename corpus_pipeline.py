"""A training-corpus pipeline over ``documents``: filter, deduplicate, cut repeats, mask secrets, pack.

Each stage gets what its predecessor kept, reread from Parquet in the shared folder. Stages but the last return
the columns of documents. Rows with a null id take part in filtering, masking and packing and are never removed as
duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import materialise, read_table
from strandloom.llm.near_dedup import near_duplicates
from strandloom.llm.packing import pack_pieces, tokenize_pieces
from strandloom.llm.quality_model import keep_documents
from strandloom.llm.secrets import redact_secrets
from strandloom.llm.substring_dedup import remove_repeats

#: Bytes of a repeat that is cut: far more than a stock phrase, well under a repeated passage of 50 words.
REPEAT_BYTES = 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return keep_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    dropped = near_duplicates(docs, words=5, threshold=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has already; a document of which nothing is left goes."""
    out = remove_repeats(docs, length=REPEAT_BYTES, carry=True)
    same = F.size("spans") == 0
    left = out.where(same | (F.trim("left") != ""))
    changed = {"text": F.when(~F.col("row.no_text"), F.col("left"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.char_length("left")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    pieces = tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: A label model, min-max hashing, suffix arrays and packing are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
