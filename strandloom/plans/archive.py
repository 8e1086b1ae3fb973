"""Compress, restore and verify read sets as directories of Parquet tables with a manifest.

compress: divide by quality, chain and lay out the HQ reads, map the LQ and N reads on that pseudogenome, lay out
the rest of each class by itself. Every read is then a position, a strand and mismatches. restore is a join of the
list with the chunks; verify compares by read_id. The manifest is written last, so a directory without one is
not an archive.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import apply_mismatches, mismatches, reverse_complement
from strandloom.operators.classify import both_sides_overlapped, classify, contains_n, demote
from strandloom.operators.layout import cut_cycles, layout, pg_chunks, slice_reads
from strandloom.operators.matching import sampled_in_chunks
from strandloom.operators.overlap import duplicate_chain, greedy_links
from strandloom.operators.store import checkpointed
from strandloom.params import EngineParams

VERSION = 1
#: Reads that are mapped at once, to bound the shuffle of their k-mers (37 of a strand of 100 bases, of 20 bytes or so);
#: each read's best match is its own. Exact matches take five k-mers of a strand, so more reads go at once.
MATCH_ROWS = 500_000
EXACT_TIMES = 6
MIS = "array<struct<off:int,ref:string,alt:string>>"


def assemble(reads: DataFrame, length: int, min_overlap: int) -> tuple[DataFrame, DataFrame]:
    """Layout with sequences, and the chunks of the pseudogenome, of one class."""
    links = checkpointed(cut_cycles(greedy_links(reads, length, min_overlap)), "links")
    placed = checkpointed(layout(reads, links, length).join(reads.select("read_id", "seq"), "read_id"), "layout")
    return placed, checkpointed(pg_chunks(placed, length), "chunks")


def listed(placed: DataFrame, name: str) -> DataFrame:
    return placed.select(F.lit(name).alias("class"), "read_id", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("rc"), F.array().cast(MIS).alias("mis"))


def mapped_in_parts(reads: DataFrame, chunks: DataFrame, length: int, most: int, seed: int, cap: int | None) -> DataFrame:
    """The best match of each read: exact ones first, then all others of the reads that have none."""

    def matched(rows: DataFrame, at_once: int, **how: bool) -> DataFrame:
        parts = -(-rows.count() // at_once) or 1
        share = lambda part: rows.where(F.pmod(F.xxhash64("read_id"), F.lit(parts)) == part)
        return reduce(DataFrame.unionByName, [checkpointed(sampled_in_chunks(share(part), chunks, length, most, seed, cap, **how), "matches") for part in range(parts)])

    reads = reads.select("read_id", "seq")
    if cap is not None:  # which k-mers a cap keeps decides which exact matches are found
        return matched(reads, MATCH_ROWS)
    exact = matched(reads.where(~contains_n(F.col("seq"))), EXACT_TIMES * MATCH_ROWS, exact_only=True)
    left = checkpointed(reads.join(exact.select("read_id"), "read_id", "left_anti"), "unmatched")
    return exact.unionByName(matched(left, MATCH_ROWS))


def build(reads: DataFrame, params: EngineParams) -> tuple[DataFrame, DataFrame, dict]:
    """reads_list, pg_seq and the manifest of a read set."""
    first = reads.select(F.length("seq").alias("n")).first()
    if first is None:
        raise ValueError("there are no reads")
    length = first["n"]
    least = params.min_overlap or 1
    ready = reads.withColumn("seq", F.when(F.col("mate") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))) if params.rc_mate2 else reads
    rows = checkpointed(classify(ready, params.err, params.suffix_mode, params.separate_n).select("read_id", "pair_id", "mate", "seq", "class"), "classified")
    hq = rows.where("class = 'HQ'").select("read_id", "seq")
    if params.ov > 0:
        links = checkpointed(duplicate_chain(hq, length).unionByName(greedy_links(hq, length, max(1, length - int(length * params.ov) + 1))).distinct(), "division-links")
        good = both_sides_overlapped(hq, links, length)
        rows = checkpointed(demote(rows, good), "classified")
        hq = rows.where("class = 'HQ'").select("read_id", "seq")
    placed, chunks = assemble(hq, length, least)
    rest = rows.where("class <> 'HQ'")
    seed = min(params.seed, length)
    found = mapped_in_parts(rest, chunks, length, length // params.min_chars_per_mismatch, seed, params.bucket_cap)
    own = slice_reads(found, chunks, length).join(rest.select("read_id", "seq"), "read_id")
    strand = F.when(F.col("rc"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    mapped = own.select(F.lit("HQ").alias("class"), "read_id", F.col("pos").cast("long").alias("pos"), "rc", mismatches(strand, F.col("slice")).cast(MIS).alias("mis"))
    lists, seqs = [listed(placed, "HQ"), mapped], [chunks.withColumn("class", F.lit("HQ"))]
    for name in ("LQ", "N") if params.separate_n else ("LQ",):
        left = rest.where(F.col("class") == name).join(found.select("read_id"), "read_id", "left_anti").select("read_id", "seq")
        p, c = assemble(left, length, least)
        lists.append(listed(p, name))
        seqs.append(c.withColumn("class", F.lit(name)))
    keys = rows.select("read_id", "pair_id", "mate")
    reads_list = reduce(DataFrame.unionByName, lists).join(keys, "read_id")
    return reads_list, reduce(DataFrame.unionByName, seqs), {"version": VERSION, "length": length, "params": asdict(params)}


def restore_rows(reads_list: DataFrame, pg_seq: DataFrame, length: int, rc_mate2: bool) -> DataFrame:
    """read_id, pair_id, mate, seq out of positions, strands and mismatches."""
    parts = []
    for name in ("HQ", "LQ", "N"):
        parts.append(slice_reads(reads_list.where(F.col("class") == name), pg_seq.where(F.col("class") == name).drop("class"), length))
    rows = reduce(DataFrame.unionByName, parts)
    fixed = apply_mismatches(F.col("slice"), F.col("mis"))
    seq = F.when(F.col("rc"), reverse_complement(fixed)).otherwise(fixed)
    rows = rows.withColumn("seq", seq)
    if rc_mate2:
        rows = rows.withColumn("seq", F.when(F.col("mate") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return rows.select("read_id", "pair_id", "mate", "seq")


def compress(reads: DataFrame, path: str, params: EngineParams | None = None) -> dict:
    params = params or EngineParams()
    reads_list, pg_seq, manifest = build(reads, params)
    reads_list.write.mode("overwrite").partitionBy("class").parquet(f"{path}/reads_list")
    pg_seq.write.mode("overwrite").partitionBy("class").parquet(f"{path}/pg_seq")
    spark = reads.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def decompress(spark: SparkSession, path: str) -> DataFrame:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] > VERSION:
        raise ValueError(f"archive version {manifest['version']} is newer than {VERSION}")
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("reads_list", "pg_seq")]
    return restore_rows(*tables, manifest["length"], manifest["params"]["rc_mate2"])


def verify(decoded: DataFrame, reads: DataFrame, mode: str = "se") -> DataFrame:
    """One row of tallies: wrong, duplicated, missing and surplus reads; by pair and mate in paired modes."""
    keys = ["read_id"]
    a = decoded.groupBy(*keys).agg(F.first("seq").alias("a"), F.first("pair_id").alias("pa"), F.count(F.lit(1)).alias("n"))
    both = a.join(reads.select("read_id", F.col("seq").alias("b"), F.col("pair_id").alias("pb")), keys, "full")
    wrong_pair = F.count_if(F.col("pa") != F.col("pb")) if mode in ("pe", "pe_ord", "min_pe") else F.lit(0).cast("long")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("wrong"), F.count_if(F.col("n") > 1).alias("duplicated"),
        F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("surplus"), wrong_pair.alias("wrong_pair"), F.count(F.lit(1)).alias("reads"),
    )
