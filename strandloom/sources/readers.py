"""Scans of read files into read_id, pair_id, mate, seq, qual, name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_complement

COLUMNS = ("read_id", "pair_id", "mate", "seq", "qual", "name")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, no: lines with their number in file order; only the lines of each split are counted beforehand."""
    rows = spark.sparkContext.textFile(path).zipWithIndex()
    return spark.createDataFrame(rows, "line string, no long")


def letters(line) -> F.Column:
    """Up to the first byte that is not a letter."""
    return F.upper(F.regexp_extract(line, "^[A-Za-z]*", 0))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """idx, seq, qual, name of records of four lines; quality is cut to the sequence's length."""
    lines = numbered_lines(spark, path).where("line <> '' OR no % 4 IN (1, 3)")
    part = lambda k: F.max(F.when(F.col("no") % 4 == k, F.col("line")))
    rec = lines.groupBy(F.floor(F.col("no") / 4).cast("long").alias("idx")).agg(part(0).alias("h"), part(1).alias("s"), part(3).alias("q")).where("s IS NOT NULL")
    seq = letters(F.col("s"))
    return rec.select("idx", seq.alias("seq"), F.substr("q", F.lit(1), F.length(seq)).alias("qual"), F.regexp_replace("h", "^@", "").alias("name"))


def _indexed(lines: DataFrame) -> DataFrame:
    rows = lines.rdd.map(lambda r: r[0]).zipWithIndex()
    return lines.sparkSession.createDataFrame(rows, "line string, idx long")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Each line that is no header is a read; lines are not joined."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^[>;]") & (F.col("value") != ""))
    return _indexed(lines).select("idx", letters(F.col("line")).alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(None).cast("string").alias("name"))


def plain(spark: SparkSession, path: str) -> DataFrame:
    return _indexed(spark.read.text(path).where("value <> ''")).select("idx", letters(F.col("line")).alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(None).cast("string").alias("name"))


def sniff(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).first()
    mark = first[0][:1] if first and first[0] else ""
    return "fastq" if mark == "@" else "fasta" if mark in (">", ";") else "plain"


SCANS = {"fastq": fastq, "fasta": fasta, "plain": plain}


def interleave(first: DataFrame, second: DataFrame | None) -> DataFrame:
    """Pair files: record i of the first is read 2i (mate 0), of the second 2i+1 (mate 1)."""
    if second is None:
        return first.select(F.col("idx").alias("read_id"), F.col("idx").alias("pair_id"), F.lit(0).alias("mate"), "seq", "qual", "name")
    mates = [d.select((F.col("idx") * 2 + m).alias("read_id"), F.col("idx").alias("pair_id"), F.lit(m).alias("mate"), "seq", "qual", "name") for m, d in enumerate((first, second))]
    return mates[0].unionByName(mates[1])


def complement_mate2(reads: DataFrame) -> DataFrame:
    return reads.withColumn("seq", F.when(F.col("mate") == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


def read(spark: SparkSession, path: str, pair_path: str | None = None, rc_mate2: bool = False, trim: bool = False, others: str = "raise") -> DataFrame:
    """Reads of one or two files of a sniffed format; plain files have no pairs.

    Lengths must agree unless ``trim`` cuts all to the shortest. Symbols other than ACGTN raise, or with
    ``others='n'`` become N.
    """
    kind = sniff(spark, path)
    scan = SCANS[kind]
    out = interleave(scan(spark, path), scan(spark, pair_path) if pair_path and kind != "plain" else None)
    stats = out.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"), F.count_if(F.col("seq").rlike("[^ACGTN]")).alias("odd")).first()
    if stats["odd"] and others == "raise":
        raise ValueError(f"{stats['odd']} reads have symbols other than ACGTN")
    if stats["odd"]:
        out = out.withColumn("seq", F.regexp_replace("seq", "[^ACGTN]", "N"))
    if stats["lo"] != stats["hi"]:
        if not trim:
            raise ValueError(f"read lengths vary from {stats['lo']} to {stats['hi']}")
        out = out.withColumns({c: F.substr(c, F.lit(1), F.lit(stats["lo"])) for c in ("seq", "qual")})
    return (complement_mate2(out) if rc_mate2 else out).select(*COLUMNS)


def read_length(reads: DataFrame) -> int | None:
    first = reads.select(F.length("seq")).first()
    return first[0] if first else None


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """read_id of a text index file: a mode line, a count, ids, an end guard."""
    lines = numbered_lines(spark, path).where("no >= 2 AND line <> ''").select(F.col("line").cast("long").alias("read_id"), "no")
    size = spark.read.text(path).take(2)
    return lines.where(F.col("no") < 2 + int(size[1][0])).select("read_id")
