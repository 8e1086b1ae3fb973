"""The derived read set: one read of 100 bases per row of ``lineitem``, cut from a genome made of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_complement
from strandloom.operators.ranking import global_rank

LENGTH, UNIT = 100, 32
HEX = "0123456789abcdef"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome_length(spark: SparkSession, sf_dir: str) -> int:
    return UNIT * table(spark, sf_dir, "part").count()


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b, w: the genome in overlapping windows, each a block of 32 bases and the four blocks after it."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    v = F.translate(F.md5(F.col("p_partkey").cast("string")), HEX, "ACGT" * 4)
    blocks = global_rank(parts, "p_partkey", [], "b").select("b", v.alias("v"))
    spread = blocks.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.struct((F.col("b") - j).alias("b"), j.alias("j"), F.col("v").alias("v")))).alias("x")).select("x.*")
    pieces = [F.coalesce(F.max(F.when(F.col("j") == j, F.col("v"))), F.lit("")) for j in range(5)]
    return spread.where("b >= 0").groupBy("b").agg(F.concat(*pieces).alias("w"))


def genome_positions(spark: SparkSession, sf_dir: str, length: int = LENGTH) -> DataFrame:
    """pos, txt: every stretch of ``length`` bases (at most 129) of the genome."""
    at = F.explode(F.sequence(F.lit(0), F.lit(UNIT - 1)))
    rows = windows(spark, sf_dir).select("b", "w", at.alias("r"))
    return rows.select((F.col("b") * UNIT + F.col("r")).alias("pos"), F.substr("w", F.col("r") + 1, F.lit(length)).alias("txt")).where(F.length("txt") == length)


def placed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads with ``st``, where on the genome each was cut."""
    li = global_rank(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")), "k", ["n"], "read_id")
    st = (F.col("k") * 7919 + F.col("n") * 104729) % (genome_length(spark, sf_dir) - 99)
    cut = li.select("read_id", st.alias("st"), F.floor(st / UNIT).cast("long").alias("b")).join(windows(spark, sf_dir), "b")
    s = F.substr("w", (F.col("st") % UNIT).cast("int") + 1, F.lit(LENGTH))
    q = F.md5(F.concat(F.lit("q"), F.col("read_id").cast("string")))
    rows = cut.select("read_id", "st", s.alias("s"), q.alias("q"))
    changed = (
        F.when(F.col("read_id") % 10 == 3, F.concat(F.substr("s", F.lit(1), F.lit(40)), F.translate(F.substr("s", F.lit(41), F.lit(1)), "ACGT", "CGTA"), F.substr("s", F.lit(42))))
        .when(F.col("read_id") % 50 == 7, F.concat(F.substr("s", F.lit(1), F.lit(60)), F.lit("N"), F.substr("s", F.lit(62))))
        .otherwise(F.col("s"))
    )
    rows = rows.withColumn("s", changed)
    qual = F.concat(F.translate("q", HEX, "IIIIIIIIIHGFEDC#"), F.translate("q", HEX, "IIIIIIIIIHGFEDC#"), F.translate("q", HEX, "IIIIIIIIIHGFED##"), F.lit("IIII"))
    return rows.select(
        "read_id",
        F.floor(F.col("read_id") / 2).cast("long").alias("pair_id"),
        (F.col("read_id") % 2).cast("int").alias("mate"),
        F.when(F.col("read_id") % 2 == 1, reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("seq"),
        qual.alias("qual"),
        F.col("st").cast("long").alias("st"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_reads(spark, sf_dir).drop("st")


#: The same in DuckDB's dialect; the queries' SQL starts with it.
SQL = """WITH blk AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS b,
  translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS v FROM part),
win AS (SELECT b, concat(v, coalesce(lead(v,1) OVER (ORDER BY b), ''), coalesce(lead(v,2) OVER (ORDER BY b), ''),
  coalesce(lead(v,3) OVER (ORDER BY b), ''), coalesce(lead(v,4) OVER (ORDER BY b), '')) AS w FROM blk),
g AS (SELECT CAST(32 * count(*) AS BIGINT) AS glen FROM part),
li AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS read_id, l_orderkey AS k, l_linenumber AS n FROM lineitem),
p AS (SELECT read_id, (k * 7919 + n * 104729) % (glen - 99) AS st FROM li CROSS JOIN g),
s0 AS (SELECT read_id, st, substr(w, CAST(st % 32 AS INT) + 1, 100) AS s, md5(concat('q', CAST(read_id AS STRING))) AS q
  FROM p JOIN win ON b = st // 32),
s1 AS (SELECT read_id, st, q, CASE
  WHEN read_id % 10 = 3 THEN concat(substr(s, 1, 40), translate(substr(s, 41, 1), 'ACGT', 'CGTA'), substr(s, 42))
  WHEN read_id % 50 = 7 THEN concat(substr(s, 1, 60), 'N', substr(s, 62)) ELSE s END AS s FROM s0),
placed AS (SELECT CAST(read_id AS BIGINT) AS read_id, CAST(read_id // 2 AS BIGINT) AS pair_id, CAST(read_id % 2 AS INT) AS mate,
  CASE WHEN read_id % 2 = 1 THEN translate(reverse(s), 'ACGTN', 'TGCAN') ELSE s END AS seq,
  concat(translate(q, '0123456789abcdef', 'IIIIIIIIIHGFEDC#'), translate(q, '0123456789abcdef', 'IIIIIIIIIHGFEDC#'),
    translate(q, '0123456789abcdef', 'IIIIIIIIIHGFED##'), 'IIII') AS qual, CAST(st AS BIGINT) AS st FROM s1),
reads AS (SELECT read_id, pair_id, mate, seq, qual FROM placed),
classified AS (SELECT *, CASE WHEN contains(seq, 'N') THEN 'N' WHEN substr(qual, 89, 1) > '#' THEN 'HQ' ELSE 'LQ' END AS class FROM placed),
gpos AS (SELECT b * 32 + r AS pos, substr(w, CAST(r AS INT) + 1, 100) AS txt FROM win, range(32) t(r)
  WHERE length(substr(w, CAST(r AS INT) + 1, 100)) = 100)"""
