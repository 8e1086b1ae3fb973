"""Every query over the read set, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import classify as C
from strandloom.operators import encode as E
from strandloom.operators import kmers as K
from strandloom.operators import layout as L
from strandloom.operators import matching as M
from strandloom.operators import overlap as O
from strandloom.operators import profile as P
from strandloom.operators import ranking as R
from strandloom.operators.store import checkpointed
from strandloom.params import EngineParams
from strandloom.plans import archive as A
from strandloom.plans import fixture as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LENGTH, KMER, MOST, SEED = X.LENGTH, "ACGTACG", 33, 38

RC = "translate(reverse(seq), 'ACGTN', 'TGCAN')"
LQN = f""", lqn AS (SELECT read_id, seq FROM classified WHERE class <> 'HQ'),
both_ AS (SELECT read_id, seq, FALSE AS rc FROM lqn UNION ALL SELECT read_id, {RC}, TRUE FROM lqn)"""
VERIFY = """, ver AS (SELECT c.read_id, c.rc, c.pos, hamming(b.seq, t.txt) AS mis FROM (SELECT DISTINCT read_id, rc, pos FROM cand) c
  JOIN gpos t ON t.pos = c.pos JOIN both_ b ON b.read_id = c.read_id AND b.rc = c.rc WHERE hamming(b.seq, t.txt) <= 33),
best AS (SELECT read_id, pos, rc, CAST(mis AS INT) AS mis FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY mis, rc, pos) AS k FROM ver) WHERE k = 1)"""
SAMPLED = (
    LQN
    + """, gk AS (SELECT pos AS gp, substr(txt, 1, 28) AS key FROM gpos UNION ALL
  SELECT pos + j, substr(txt, CAST(j AS INT) + 1, 28) FROM (SELECT * FROM gpos ORDER BY pos DESC LIMIT 1), range(1, 73) t(j)),
rk AS (SELECT read_id, rc, o AS off, substr(seq, CAST(o AS INT) + 1, 28) AS key FROM both_, range(0, 73, 2) t(o)),
cand AS (SELECT read_id, rc, gp - off AS pos FROM rk JOIN gk ON rk.key = gk.key WHERE gp % 5 = 0 AND gp - off >= 0)"""
    + VERIFY
)
MISROWS = """, mrows AS (SELECT read_id, rc, i - 1 AS off, substr(txt, CAST(i AS INT), 1) AS ref, substr(s, CAST(i AS INT), 1) AS alt FROM
  (SELECT best.read_id, best.rc, txt, both_.seq AS s FROM best JOIN gpos ON gpos.pos = best.pos JOIN both_ ON both_.read_id = best.read_id AND both_.rc = best.rc WHERE mis > 0),
  range(1, 101) t(i) WHERE substr(txt, CAST(i AS INT), 1) <> substr(s, CAST(i AS INT), 1))"""
LISTED = """, rl AS (SELECT CAST(row_number() OVER (ORDER BY st, read_id) - 1 AS BIGINT) AS rl_idx, read_id, pair_id, mate, st AS pos FROM classified WHERE class = 'HQ')"""
DUP = """, links AS (SELECT read_id, next_id, CAST(100 AS INT) AS overlap FROM (SELECT read_id, lead(read_id) OVER (PARTITION BY seq ORDER BY read_id) AS next_id FROM classified WHERE class = 'HQ') WHERE next_id IS NOT NULL)"""


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = X.SQL + sql
        return f

    return register


def classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.placed_reads(spark, sf)
    return C.classify(rows.select(F.inline(F.array(F.struct(*rows.columns)))))  # else a test of the class would make seq and qual again


def hq(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).where("class = 'HQ'")


def low(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).where("class <> 'HQ'")


def mapped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LQ and N reads, the genome's stretches, and the best matches; what is used twice is written once."""
    rows, text = checkpointed(low(spark, sf).select("read_id", "seq"), "low"), checkpointed(X.genome_positions(spark, sf), "text")
    return rows, text, M.sampled(rows, text, LENGTH, MOST, SEED)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The genome in overlapping chunks of ``X.UNIT`` bases."""
    return X.windows(spark, sf).select(F.col("b").alias("chunk"), (F.col("b") * X.UNIT).alias("start"), F.col("w").alias("seq"))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """HQ reads in list order with their pairs."""
    return R.global_rank(hq(spark, sf).select("read_id", "pair_id", "mate", F.col("st").alias("pos")), "pos", ["read_id"], "rl_idx")


@query(" SELECT class, count(*) AS n FROM classified GROUP BY class")
def class_counts(spark, sf):
    return P.class_counts(classified(spark, sf))


@query(" SELECT read_id, class FROM classified")
def division_rows(spark, sf):
    return classified(spark, sf).select("read_id", "class")


@query(" SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(seq, 'N') THEN 'N' ELSE 'HQ' END AS class FROM reads) GROUP BY class")
def simple_division(spark, sf):
    return P.class_counts(C.classify(X.reads(spark, sf), err=1.0))


@query(" SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS total_length, CAST(min(length(seq)) AS INT) AS min_length, CAST(max(length(seq)) AS INT) AS max_length, min(length(seq)) = max(length(seq)) AS constant, (SELECT string_agg(s, '' ORDER BY s) FROM (SELECT DISTINCT unnest(string_split(seq, '')) AS s FROM reads)) AS symbols FROM reads")
def reads_profile(spark, sf):
    return P.reads_profile(X.reads(spark, sf))


@query(" SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS symbol FROM reads) GROUP BY symbol")
def symbol_counts(spark, sf):
    return P.symbol_counts(X.reads(spark, sf))


@query(" SELECT read_id FROM reads WHERE contains(seq, 'N')")
def contains_n(spark, sf):
    return X.reads(spark, sf).where(C.contains_n(F.col("seq"))).select("read_id")


@query(" SELECT read_id FROM reads WHERE NOT contains(seq, 'N')")
def ignore_n(spark, sf):
    return X.reads(spark, sf).where(~C.contains_n(F.col("seq"))).select("read_id")


@query(" SELECT read_id, substr(qual, 89, 1) > '#' AS high FROM reads")
def suffix_quality(spark, sf):
    return X.reads(spark, sf).select("read_id", C.suffix_quality(F.col("qual"), LENGTH).alias("high"))


PROB = "CASE WHEN ascii(x) - 33 <= 0 THEN 0.0 WHEN ascii(x) - 33 >= 41 THEN 1.0 ELSE 1 - power(10.0, -(ascii(x) - 33) / 10.0) END"


@query(f" SELECT read_id, round(avg({PROB}), 6) AS p FROM (SELECT read_id, unnest(string_split(qual, '')) AS x FROM reads) GROUP BY read_id")
def mean_quality_prob(spark, sf):
    return X.reads(spark, sf).select("read_id", F.round(S.mean_correct(F.col("qual")), 6).alias("p"))


@query(f" SELECT read_id, round(avg({PROB}), 6) AS p FROM (SELECT read_id, unnest(string_split(substr(qual, 51, 50), '')) AS x FROM reads) GROUP BY read_id")
def tail_quality_prob(spark, sf):
    return X.reads(spark, sf).select("read_id", F.round(S.mean_correct(F.col("qual"), (0.5, 1.0)), 6).alias("p"))


@query(f" SELECT read_id, round(exp(avg(ln({PROB}))), 6) AS p FROM (SELECT read_id, unnest(string_split(qual, '')) AS x FROM reads) GROUP BY read_id")
def geo_mean_quality(spark, sf):
    return X.reads(spark, sf).select("read_id", F.round(S.geometric_correct(F.col("qual")), 6).alias("p"))


@query(f" SELECT read_id, {RC} AS rc FROM reads")
def reverse_complement(spark, sf):
    return X.reads(spark, sf).select("read_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(" SELECT pair_id * 2 + mate AS read_id, seq FROM reads")
def pair_interleave(spark, sf):
    from strandloom.sources.readers import interleave

    r = X.reads(spark, sf)
    one, two = (r.where(F.col("mate") == m).select(F.col("pair_id").alias("idx"), "seq", "qual", F.lit(None).cast("string").alias("name")) for m in (0, 1))
    return interleave(one, two).select("read_id", "seq")


@query(f" SELECT read_id, CASE WHEN mate = 1 THEN {RC} ELSE seq END AS seq FROM reads")
def complement_mate2(spark, sf):
    from strandloom.sources.readers import complement_mate2 as f

    return f(X.reads(spark, sf)).select("read_id", "seq")


@query(" SELECT a.pair_id, a.read_id, b.read_id AS mate_id FROM reads a JOIN reads b ON a.pair_id = b.pair_id AND a.mate = 0 AND b.mate = 1")
def mate_join(spark, sf):
    ids = X.reads(spark, sf).groupBy("pair_id").agg(F.max(F.when(F.col("mate") == 0, F.col("read_id"))).alias("read_id"), F.max(F.when(F.col("mate") == 1, F.col("read_id"))).alias("mate_id"))
    return ids.where("read_id IS NOT NULL AND mate_id IS NOT NULL")


@query(DUP + " SELECT read_id, next_id FROM links")
def duplicate_chain(spark, sf):
    return O.duplicate_chain(hq(spark, sf), LENGTH).select("read_id", "next_id")


@query(" SELECT count(*) - count(DISTINCT seq) AS duplicates FROM classified WHERE class = 'HQ'")
def duplicate_count(spark, sf):
    return P.duplicate_count(hq(spark, sf))


def _overlap(overlap: int) -> None:
    cut = LENGTH - overlap
    sql = f""", d AS (SELECT min(read_id) AS read_id, seq FROM classified WHERE class = 'HQ' GROUP BY seq),
s AS (SELECT read_id, substr(seq, {cut + 1}) AS k, row_number() OVER (PARTITION BY substr(seq, {cut + 1}) ORDER BY read_id) AS rn FROM d),
q AS (SELECT read_id, substr(seq, 1, {overlap}) AS k, row_number() OVER (PARTITION BY substr(seq, 1, {overlap}) ORDER BY read_id) AS rn FROM d)
SELECT s.read_id, q.read_id AS next_id FROM s JOIN q ON s.k = q.k AND s.rn = q.rn WHERE s.read_id <> q.read_id"""

    @query(sql, f"overlap_l{overlap}")
    def run(spark, sf):
        d = hq(spark, sf).groupBy("seq").agg(F.min("read_id").alias("read_id"))
        return O.overlap_pairs(d, d, LENGTH, overlap).select("read_id", "next_id")


for _n in (99, 80, 50):
    _overlap(_n)

OCC = f", occ AS (SELECT read_id, i AS off FROM reads, range(0, 94) t(i) WHERE contains(seq, '{KMER}') AND substr(seq, CAST(i AS INT) + 1, 7) = '{KMER}')"


@query(f" SELECT read_id FROM reads WHERE contains(seq, '{KMER}')")
def kmer_reads(spark, sf):
    return K.reads_containing(X.reads(spark, sf), KMER)


@query(f" SELECT count(*) AS n FROM reads WHERE contains(seq, '{KMER}')")
def kmer_count(spark, sf):
    return K.reads_containing(X.reads(spark, sf), KMER).agg(F.count(F.lit(1)).alias("n"))


@query(OCC + " SELECT read_id, CAST(off AS INT) AS off FROM occ")
def kmer_occurrences(spark, sf):
    return K.occurrences(X.reads(spark, sf), KMER).select("read_id", "off")


@query(OCC + " SELECT read_id * 100 + off AS flat FROM occ")
def kmer_flat(spark, sf):
    return K.flat_occurrences(X.reads(spark, sf), KMER)


@query(OCC + " SELECT read_id FROM occ GROUP BY read_id HAVING count(*) = 1")
def kmer_single_reads(spark, sf):
    return K.single_occurrences(X.reads(spark, sf), KMER).select("read_id")


@query(OCC + " SELECT count(*) AS n FROM (SELECT read_id FROM occ GROUP BY read_id HAVING count(*) = 1)")
def kmer_single_count(spark, sf):
    return K.single_occurrences(X.reads(spark, sf), KMER).agg(F.count(F.lit(1)).alias("n"))


@query(OCC + " SELECT read_id, CAST(min(off) AS INT) AS off FROM occ GROUP BY read_id HAVING count(*) = 1")
def kmer_single_occ(spark, sf):
    return K.single_occurrences(X.reads(spark, sf), KMER).select("read_id", "off")


@query(" SELECT DISTINCT read_id FROM (SELECT read_id, substr(seq, CAST(i AS INT) + 1, 11) AS k FROM reads, range(0, 90) t(i) GROUP BY ALL HAVING count(*) > 1)")
def repeated_kmer_reads(spark, sf):
    return K.repeated_kmer_reads(X.reads(spark, sf))


@query(" SELECT kmer, n, CAST(coalesce(sum(n) OVER (ORDER BY kmer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT substr(txt, 1, 6) AS kmer, count(*) AS n FROM gpos GROUP BY kmer)")
def kmer_counts(spark, sf):
    return K.kmer_counts(X.genome_positions(spark, sf), 6)


@query(" SELECT pos, kmer FROM (SELECT pos, substr(txt, 1, 5) AS kmer, row_number() OVER (PARTITION BY substr(txt, 1, 5) ORDER BY pos) AS k FROM gpos) WHERE k <= 13")
def kmer_bucket_cap(spark, sf):
    return K.capped_buckets(X.genome_positions(spark, sf), 5).select("pos", "kmer")


@query(", top AS (SELECT st, max(read_id) AS read_id FROM placed GROUP BY st) SELECT pr.pos AS probe, top.read_id FROM (SELECT pos FROM gpos) pr ASOF LEFT JOIN top ON pr.pos >= top.st")
def asof_read(spark, sf):
    probes = X.genome_positions(spark, sf).select(F.col("pos").alias("probe"))
    return R.asof(probes, "probe", X.placed_reads(spark, sf), "st", "read_id", "read_id")


@query(LQN + " SELECT read_id, pos, rc FROM (SELECT read_id, pos, rc, row_number() OVER (PARTITION BY read_id ORDER BY rc, pos) AS k FROM both_ JOIN gpos ON seq = txt) WHERE k = 1")
def exact_match(spark, sf):
    rows, chunks = checkpointed(low(spark, sf).select("read_id", "seq"), "low"), checkpointed(_chunks(spark, sf), "chunks")
    return M.exact_in_chunks(rows, chunks, LENGTH, X.UNIT).select("read_id", "pos", "rc")


@query(LQN + ", cand AS (SELECT read_id, rc, pos FROM both_ JOIN gpos ON substr(seq, 1, 38) = substr(txt, 1, 38) UNION ALL SELECT read_id, rc, pos FROM both_ JOIN gpos ON substr(seq, 39, 38) = substr(txt, 39, 38))" + VERIFY + " SELECT read_id, pos, rc, mis FROM best")
def pigeonhole_match(spark, sf):
    rows, text = checkpointed(low(spark, sf).select("read_id", "seq"), "low"), checkpointed(X.genome_positions(spark, sf), "text")
    return M.seeded(rows, text, LENGTH, MOST, SEED)


@query(LQN + r", cand AS (SELECT read_id, rc, pos FROM both_ JOIN gpos ON regexp_replace(seq, '(.).', '\1', 'g') = regexp_replace(txt, '(.).', '\1', 'g') UNION ALL SELECT read_id, rc, pos FROM both_ JOIN gpos ON regexp_replace(seq, '.(.)', '\1', 'g') = regexp_replace(txt, '.(.)', '\1', 'g'))" + VERIFY + " SELECT read_id, pos, rc, mis FROM best")
def interleaved_match(spark, sf):
    rows, text = checkpointed(low(spark, sf).select("read_id", "seq"), "low"), checkpointed(X.genome_positions(spark, sf), "text")
    return M.interleaved(rows, text, LENGTH, MOST, 2)


@query(SAMPLED + " SELECT read_id, pos, rc, mis FROM best")
def coprime_match(spark, sf):
    return mapped(spark, sf)[2]


@query(SAMPLED + " SELECT mis, count(*) AS n FROM lqn LEFT JOIN best USING (read_id) GROUP BY mis")
def match_histogram(spark, sf):
    rows, _, found = mapped(spark, sf)
    return M.match_histogram(rows, found)


@query(SAMPLED + " SELECT read_id FROM lqn WHERE read_id NOT IN (SELECT read_id FROM best)")
def anti_mapped(spark, sf):
    rows, _, found = mapped(spark, sf)
    return C.division(rows, found, complement=True).select("read_id")


@query(SAMPLED + MISROWS + " SELECT CAST(CASE WHEN rc THEN 99 - off ELSE off END AS INT) AS off, count(*) AS n FROM mrows GROUP BY 1")
def mismatch_by_position(spark, sf):
    rows, text, found = mapped(spark, sf)
    return M.mismatch_positions(M.mismatch_rows(rows, found, text), LENGTH).select(F.col("off").cast("int").alias("off"), "n")


@query(SAMPLED + MISROWS + " SELECT read_id, CAST(off AS INT) AS off, CAST(strpos('ACGTN', alt) - 1 - CASE WHEN strpos('ACGTN', alt) > strpos('ACGTN', ref) THEN 1 ELSE 0 END AS INT) AS code, CAST((strpos('ACGTN', ref) - 1) * 16 + strpos('ACGTN', alt) - 1 AS INT) AS context FROM mrows")
def mismatch_codes(spark, sf):
    rows, text, found = mapped(spark, sf)
    m = M.mismatch_rows(rows, found, text)
    return m.select("read_id", "off", S.mismatch_code(F.col("ref"), F.col("alt")).alias("code"), S.context_code(F.col("ref"), F.col("alt")).alias("context"))


@query(SAMPLED + MISROWS + " SELECT alt, n, row_number() OVER (ORDER BY n DESC, alt) AS rank FROM (SELECT alt, count(*) AS n FROM mrows GROUP BY alt)")
def base_order(spark, sf):
    rows, text, found = mapped(spark, sf)
    return M.base_order(M.mismatch_rows(rows, found, text))


@query(SAMPLED + MISROWS + ", o AS (SELECT read_id, off, lead(off) OVER (PARTITION BY read_id ORDER BY off) AS nxt FROM mrows) SELECT read_id, string_agg(CAST(coalesce(nxt, 100) - off - 1 AS VARCHAR), ',' ORDER BY off DESC) AS gaps FROM o GROUP BY read_id")
def rev_offset_delta(spark, sf):
    rows, text, found = mapped(spark, sf)
    return E.reverse_gaps(M.mismatch_rows(rows, found, text), LENGTH)


def _mis_listed(spark, sf):
    found = checkpointed(mapped(spark, sf)[2], "found")
    return R.global_rank(found.select("read_id", "pos", F.col("mis").alias("mis_cnt")), "pos", ["read_id"], "rl_idx")


MISLIST = SAMPLED + ", ml AS (SELECT CAST(row_number() OVER (ORDER BY pos, read_id) - 1 AS BIGINT) AS rl_idx, mis AS mis_cnt FROM best)"


@query(MISLIST + " SELECT rl_idx, mis_cnt, CAST(sum(mis_cnt) OVER (ORDER BY rl_idx) AS BIGINT) AS mis_cum FROM ml")
def mismatch_cumsum(spark, sf):
    return E.mismatch_cumulative(_mis_listed(spark, sf))


@query(MISLIST + " SELECT rl_idx, mis_cnt = 0 AS zero, CASE WHEN mis_cnt <> 0 THEN mis_cnt END AS nonzero FROM ml")
def zero_split(spark, sf):
    return E.zero_split(_mis_listed(spark, sf))


@query(MISLIST + " SELECT mis_cnt, n, CAST(coalesce(sum(n * mis_cnt) OVER (ORDER BY mis_cnt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT mis_cnt, count(*) AS n FROM ml WHERE mis_cnt > 0 GROUP BY mis_cnt)")
def mismatch_groups(spark, sf):
    return E.mismatch_groups(_mis_listed(spark, sf))


@query(LISTED + " SELECT rl_idx, read_id, pos - coalesce(lag(pos) OVER (ORDER BY rl_idx), 0) AS off FROM rl")
def offset_delta(spark, sf):
    return E.offset_delta(hq(spark, sf).select("read_id", F.col("st").alias("pos")))


@query(LISTED + " SELECT rl_idx, read_id, pos FROM rl")
def position_cumsum(spark, sf):
    offsets = checkpointed(E.offset_delta(hq(spark, sf).select("read_id", F.col("st").alias("pos"))), "offsets")
    return E.positions(offsets).select("rl_idx", "read_id", "pos")


@query(LISTED + " SELECT min(rl_idx) AS base_rl, CASE WHEN max(rl_idx) - min(rl_idx) <= 255 THEN max(rl_idx) - min(rl_idx) END AS u8 FROM rl GROUP BY pair_id HAVING count(*) = 2")
def pair_offset_u8(spark, sf):
    p = E.pair_offsets(listed(spark, sf)).where("offset > 0")
    return p.select("base_rl", F.when(F.col("offset") <= 255, F.col("offset")).alias("u8"))


@query(", pr AS (SELECT pair_id, max(CASE WHEN mate = 0 THEN st END) AS a, max(CASE WHEN mate = 1 THEN st END) AS b FROM placed GROUP BY pair_id) SELECT pair_id, row_number() OVER (ORDER BY a, pair_id) - 1 AS base_rank, CASE WHEN abs(b - a) <= 65535 THEN abs(b - a) END AS u16, b < a AS backward FROM pr WHERE a IS NOT NULL AND b IS NOT NULL")
def pair_pos_u16(spark, sf):
    p = E.pair_positions(X.placed_reads(spark, sf).withColumnRenamed("st", "pos"))
    return p.select("pair_id", "base_rank", F.when(F.col("distance") <= 65535, F.col("distance")).alias("u16"), "backward")


@query(" SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT class, count(*) AS n FROM classified GROUP BY class)")
def order_entropy(spark, sf):
    return P.entropy(classified(spark, sf), "class").select(F.round("entropy", 6).alias("entropy"))


@query(" SELECT read_id, class FROM classified WHERE class <> 'HQ'")
def union_sets(spark, sf):
    c = classified(spark, sf).select("read_id", "class")
    return c.where("class = 'LQ'").unionByName(c.where("class = 'N'"))


@query(" SELECT read_id FROM classified WHERE class = 'LQ'")
def semi_division(spark, sf):
    r = X.reads(spark, sf)
    return C.division(r, classified(spark, sf).where("class = 'LQ'")).select("read_id")


@query(" SELECT read_id FROM classified WHERE class = 'HQ'")
def anti_division(spark, sf):
    return C.division(X.reads(spark, sf), low(spark, sf), complement=True).select("read_id")


@query(" SELECT read_id, class FROM classified")
def reload_division(spark, sf):
    c = classified(spark, sf)
    return C.reload_division(X.reads(spark, sf), c.where("class = 'LQ'"), c.where("class = 'N'")).select("read_id", "class")


MEM = """, gk AS (SELECT pos AS gp, substr(txt, 1, 12) AS key FROM gpos UNION ALL SELECT pos + j, substr(txt, CAST(j AS INT) + 1, 12) FROM (SELECT * FROM gpos ORDER BY pos DESC LIMIT 1), range(1, 89) t(j)),
rk AS (SELECT glen - 12 - gp AS gp, translate(reverse(key), 'ACGTN', 'TGCAN') AS key FROM gk CROSS JOIN g),
h AS (SELECT a.gp AS src, b.gp AS dest, a.gp - b.gp AS dg FROM gk a JOIN rk b ON a.key = b.key),
i AS (SELECT *, dest - row_number() OVER (PARTITION BY dg ORDER BY dest) AS isl FROM h)
SELECT min(src) AS src_pos, min(dest) AS dest_pos, count(*) + 11 AS length FROM i GROUP BY dg, isl HAVING count(*) + 11 >= 14"""


@query(MEM)
def mem_islands(spark, sf):
    text = checkpointed(X.genome_positions(spark, sf), "text")
    own = M.text_kmers(text, 12, LENGTH)
    back = own.select((F.lit(X.genome_length(spark, sf) - 12) - F.col("at")).alias("at"), S.reverse_complement(F.col("key")).alias("key"))
    return M.maximal_matches(own, back, 12, 14)


@query(", iv AS (SELECT b * 32 AS src_pos, 150 + b % 200 AS length FROM win) SELECT read_id, src_pos, length FROM placed JOIN iv ON st >= src_pos AND st + 100 <= src_pos + length")
def interval_contains(spark, sf):
    iv = X.windows(spark, sf).select((F.col("b") * 32).alias("src_pos"), (F.col("b") % 200 + 150).alias("length"))
    return M.contained(X.placed_reads(spark, sf).select("read_id", F.col("st").alias("pos")), iv, LENGTH)


@query(", iv AS (SELECT b * 32 AS src_pos, 20 + (b * 37) % 200 AS length FROM win) SELECT src_pos, length, max(src_pos + length) OVER (ORDER BY src_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS end_before FROM iv")
def interval_running_end(spark, sf):
    iv = X.windows(spark, sf).select((F.col("b") * 32).alias("src_pos"), ((F.col("b") * 37) % 200 + 20).alias("length"))
    return R.running_max_before(iv, "src_pos", ["length"], F.col("src_pos") + F.col("length"), "end_before")


@query(" SELECT read_id, CAST(greatest(1, ceil(length(bin(read_id)) / 7.0)) AS INT) AS size FROM reads")
def varint_size(spark, sf):
    return X.reads(spark, sf).select("read_id", S.varint_size(F.col("read_id")).alias("size"))


@query(" SELECT CASE WHEN max(read_id) = 0 THEN 0 ELSE length(bin(max(read_id))) END / 32.0 AS estimate FROM reads")
def bits_estimate(spark, sf):
    return P.bits_estimate(X.reads(spark, sf), "read_id")


@query(" SELECT CAST(sum(length(seq) + 1) AS BIGINT) AS bytes FROM reads")
def stream_size(spark, sf):
    return P.stream_size(X.reads(spark, sf))


@query(DUP + " SELECT read_id FROM links UNION SELECT next_id FROM links")
def both_sides_overlapped(spark, sf):
    r = hq(spark, sf)
    return C.both_sides_overlapped(r, O.duplicate_chain(r, LENGTH), LENGTH).select("read_id")


@query(DUP + " SELECT CAST((SELECT count(*) FROM classified WHERE class = 'HQ') * 100 - (SELECT sum(overlap) FROM links) AS BIGINT) AS pg_length")
def pg_length(spark, sf):
    r = hq(spark, sf)
    return P.pg_length(O.duplicate_chain(r, LENGTH), r, LENGTH)


@query(DUP + " SELECT (SELECT count(*) FROM links WHERE read_id NOT IN (SELECT next_id FROM links)) AS components, (SELECT count(*) FROM classified WHERE class = 'HQ' AND read_id NOT IN (SELECT read_id FROM links) AND read_id NOT IN (SELECT next_id FROM links)) AS singles")
def component_counts(spark, sf):
    r = hq(spark, sf)
    return P.component_counts(O.duplicate_chain(r, LENGTH), r)


@query(" SELECT read_id, substr(seq, 11, 20) AS part FROM reads")
def read_slice(spark, sf):
    return X.reads(spark, sf).select("read_id", F.substr("seq", F.lit(11), F.lit(20)).alias("part"))


@query(" SELECT read_id, substr(txt, 1, 100) AS slice FROM placed JOIN gpos ON pos = st")
def pg_slice(spark, sf):
    w = X.windows(spark, sf).withColumnRenamed("b", "chunk").select("chunk", (F.col("chunk") * 32).alias("start"), F.col("w").alias("seq"))
    rows = X.placed_reads(spark, sf).select("read_id", F.col("st").alias("pos"))
    return L.slice_reads(rows, w, LENGTH, chunk=32).select("read_id", "slice")


@query(" SELECT read_id, len(regexp_extract_all(seq, '[ACGT]{3}|[ACGT]{2}|.')) AS tokens FROM reads")
def dna_tokens(spark, sf):
    return X.reads(spark, sf).select("read_id", F.size(S.tokenize_dna(F.col("seq"))).cast("long").alias("tokens"))


@query(" SELECT seq, min(read_id) AS head, max(read_id) AS tail FROM classified WHERE class = 'HQ' GROUP BY seq")
def chain_ends(spark, sf):
    return O.chain_ends(hq(spark, sf))


@query(" SELECT read_id, CAST(row_number() OVER (ORDER BY st, read_id) - 1 AS BIGINT) AS rl_idx FROM placed")
def read_order(spark, sf):
    return R.global_rank(X.placed_reads(spark, sf), "st", ["read_id"], "rl_idx").select("read_id", "rl_idx")


def _assembled(spark, sf) -> tuple[DataFrame, DataFrame]:
    r = hq(spark, sf).select("read_id", "seq")
    return r, checkpointed(L.cut_cycles(O.greedy_links(r, LENGTH, 1)), "links")


@query(None)
def assemble_links(spark, sf):
    return _assembled(spark, sf)[1]


@query(None)
def layout(spark, sf):
    return L.layout(*_assembled(spark, sf), LENGTH)


@query(None)
def pg_in_pg(spark, sf):
    """Reverse-complement repeats of the genome in itself, each source before its destination, without overlap."""
    n = X.genome_length(spark, sf)
    m = mem_islands(spark, sf).select("src_pos", (F.lit(n) - F.col("dest_pos") - F.col("length")).alias("dest_pos"), "length")
    ordered = m.select(F.least("src_pos", "dest_pos").alias("src_pos"), F.greatest("src_pos", "dest_pos").alias("dest_pos"), "length").distinct()
    # where a repeat meets itself, each side keeps its half
    room = F.col("dest_pos") - F.col("src_pos")
    halved = ordered.withColumn("cut", F.greatest(F.lit(0), F.col("length") - room)).select("src_pos", (F.col("dest_pos") + F.col("cut")).alias("dest_pos"), (F.col("length") - F.col("cut")).cast("long").alias("length"))
    return E.trim_matches(halved.where("length > 0").select(F.lit("HQ").alias("dest_class"), "dest_pos", "src_pos", "length", F.lit(True).alias("rc")), 14)


def _round_trip(mode: str) -> None:
    @query(f" SELECT CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS duplicated, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS surplus, CAST(0 AS BIGINT) AS wrong_pair, count(*) AS reads FROM reads", f"roundtrip_{mode}")
    def run(spark, sf):
        reads = checkpointed(X.reads(spark, sf), "reads")
        params = EngineParams(mode=mode, rc_mate2=mode.startswith("pe"), min_overlap=1)
        reads_list, pg_seq, manifest = A.build(reads, params)
        decoded = A.restore_rows(checkpointed(reads_list, "list"), checkpointed(pg_seq, "pg"), manifest["length"], params.rc_mate2)
        return A.verify(decoded, reads, mode)


for _m in ("se", "pe", "pe_ord"):
    _round_trip(_m)
