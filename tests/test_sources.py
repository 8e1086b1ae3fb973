"""Readers, sinks and scalar functions."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import encode as E
from strandloom.sources import readers, sinks


def test_fastq_pair(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r0\nACGT.\n+\nIIII#\n@r1\nGGTA\n+\nII##\n")
    (tmp_path / "b.fq").write_text("@r0\nTTTT\n+\nIIII\n@r1\nCCCA\n+\nIIII\n")
    got = readers.read(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fq"), rc_mate2=True).orderBy("read_id").collect()
    assert [(r.read_id, r.pair_id, r.mate, r.seq, r.qual, r.name) for r in got] == [(0, 0, 0, "ACGT", "IIII", "r0"), (1, 0, 1, "AAAA", "IIII", "r0"), (2, 1, 0, "GGTA", "II##", "r1"), (3, 1, 1, "TGGG", "IIII", "r1")]


def test_fasta_plain_and_lengths(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">h\nACGT\n;c\nAACC\n")
    (tmp_path / "x.txt").write_text("ACGTA\nACGT\n")
    assert [r.seq for r in readers.read(spark, str(tmp_path / "x.fa")).orderBy("read_id").collect()] == ["ACGT", "AACC"]
    with pytest.raises(ValueError, match="lengths"):
        readers.read(spark, str(tmp_path / "x.txt"))
    assert [r.seq for r in readers.read(spark, str(tmp_path / "x.txt"), trim=True).orderBy("read_id").collect()] == ["ACGT", "ACGT"]


def test_mapping_file(spark, tmp_path):
    (tmp_path / "m").write_text("TXT\n3\n1\n4\n9\n10\n")
    assert sorted(r.read_id for r in readers.load_mapping(spark, str(tmp_path / "m")).collect()) == [1, 4, 9]


def test_ordered_sink(spark, tmp_path):
    reads = spark.createDataFrame([(1, 0, 1, "CC"), (0, 0, 0, "AA"), (2, 1, 0, "GG"), (3, 1, 1, "TT")], "read_id long, pair_id long, mate int, seq string")
    sinks.write_ordered(reads, str(tmp_path / "one"))
    sinks.write_ordered(reads, str(tmp_path / "p1"), str(tmp_path / "p2"))
    text = lambda p: [r[0] for r in spark.read.text(str(tmp_path / p)).collect()]
    assert text("one") == ["AA", "CC", "GG", "TT"] and text("p1") == ["AA", "GG"] and text("p2") == ["CC", "TT"]


def test_codes_offsets_and_strides(spark):
    d = spark.range(1).select(
        S.code_mismatch(F.lit("C"), S.mismatch_code(F.lit("C"), F.lit("T"))).alias("back"),
        S.forward_offsets(S.reverse_offsets(F.array(F.lit(3), F.lit(40), F.lit(99)), F.lit(100)), F.lit(100)).alias("offs"),
        S.strided(F.lit("ACGTAC"), 2, 1).alias("odd"),
        S.hamming(F.lit("ACGT"), F.lit("ATGA")).alias("h"),
        S.reverse_complement(F.lit("acgRN")).alias("rc"),
        (F.lit(4) - S.matches(S.lanes(F.lit("ACGN"), 4), S.lanes(F.lit("ACTN"), 4))).alias("mis"),
    ).first()
    assert (d.back, d.offs, d.odd, d.h, d.rc, d.mis) == ("T", [3, 40, 99], "CTC", 2, "NYCGT", 2)


def test_sticky_coding_inverts(spark):
    values = [3, 400, 420, 255, 256, 90000, 89990, 70000]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    coded = E.sticky_delta(rows, "i", "v", 255, 128)
    back = E.restore_sticky(coded, "i", "w").orderBy("i").collect()
    assert [r.w for r in back] == values
    assert {r.enc for r in back} == {"small", "delta", "full"}


def test_trim_keeps_order(spark):
    m = spark.createDataFrame([("HQ", 0, 50, 20), ("HQ", 10, 80, 30), ("HQ", 35, 90, 10)], "dest_class string, dest_pos long, src_pos long, length long")
    assert sorted((r.dest_pos, r.length) for r in E.trim_matches(m, 10).collect()) == [(0, 20), (20, 20)]


def test_stream_division(spark, tmp_path):
    from strandloom.streaming.division import classified_stream, read_stream

    spark.createDataFrame([(0, 0, 0, "ACGN", "IIII"), (1, 0, 1, "ACGT", "II##"), (2, 1, 0, "ACGT", "IIII")], "read_id long, pair_id long, mate int, seq string, qual string").write.parquet(str(tmp_path / "in"))
    q = classified_stream(read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("divided").start()
    q.processAllAvailable()
    q.stop()
    assert {r.read_id: r["class"] for r in spark.table("divided").collect()} == {0: "N", 1: "LQ", 2: "HQ"}


def test_command_line_parameters():
    from strandloom.cli import params_of, parser

    p = params_of(parser().parse_args(["arch", "-q", "100", "-s", "30", "-o", "-i", "a.fq", "b.fq"]))
    assert (p.err, p.seed, p.mode, p.rc_mate2) == (0.1, 30, "pe_ord", True)
    with pytest.raises(SystemExit):
        params_of(parser().parse_args(["arch", "-S", "-o", "-i", "a.fq"]))
    with pytest.raises(ValueError, match="seed"):
        params_of(parser().parse_args(["arch", "-s", "10", "-i", "a.fq"]))
