"""Assembly, layout and archives on hand-built reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import classify as C
from strandloom.operators import layout as L
from strandloom.operators import overlap as O
from strandloom.operators.kmers import repeats_inside
from strandloom.params import EngineParams
from strandloom.plans import archive as A
from strandloom.plans import registry

READS = "read_id long, pair_id long, mate int, seq string, qual string"


def table(spark, seqs):
    return spark.createDataFrame([(i, i // 2, i % 2, s, "I" * len(s)) for i, s in enumerate(seqs)], READS)


def links_of(spark, seqs, least):
    r = table(spark, seqs)
    return r, L.cut_cycles(O.greedy_links(r, len(seqs[0]) if seqs else 8, least))


def test_duplicates_chain(spark):
    r = table(spark, ["AACCGGTT"] * 3)
    assert sorted(map(tuple, O.duplicate_chain(r, 8).collect())) == [(0, 1, 8), (1, 2, 8)]


def test_chain_is_one_component(spark):
    seqs = ["ACCTGATT", "CTGATTGC", "GATTGCAA"]
    r, links = links_of(spark, seqs, 4)
    placed = L.layout(r, links, 8).join(r.select("read_id", "seq"), "read_id")
    got = {x.read_id: (x.comp_id, x.comp_rank, x.pos) for x in placed.collect()}
    assert got == {0: (0, 0, 0), 1: (0, 1, 2), 2: (0, 2, 4)}
    assert "".join(x.seq for x in L.pg_chunks(placed, 8).collect()) == "ACCTGATTGCAA"


def test_single_read_does_not_follow_itself(spark):
    r, links = links_of(spark, ["ACGTACGT"], 3)
    assert links.count() == 0
    assert [(x.pos, x.off) for x in L.layout(r, links, 8).collect()] == [(0, 8)]


def test_cycle_is_cut_once(spark):
    ring = "ACCTGATTGCAAGT"
    seqs = [(ring + ring)[i : i + 8] for i in range(0, len(ring), 2)]
    r, links = links_of(spark, seqs, 4)
    assert links.count() == len(seqs) - 1
    assert sorted(x.comp_rank for x in L.layout(r, links, 8).collect()) == list(range(len(seqs)))


def test_links_join_equal_ends(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("AC") for _ in range(12)) for _ in range(60)]
    _, links = links_of(spark, seqs, 6)
    found = links.collect()
    assert all(seqs[x.read_id][12 - x.overlap :] == seqs[x.next_id][: x.overlap] for x in found)
    assert len({x.read_id for x in found}) == len(found) == len({x.next_id for x in found})


def test_one_task_links_like_many(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACN") for _ in range(10)) for _ in range(80)]
    seqs += seqs[:5]
    r = table(spark, seqs)
    got = [sorted(map(tuple, O.greedy_links(r, 10, 1, task_rows=n).select("read_id", "next_id", "overlap").collect())) for n in (0, 60, 1000)]
    assert got[0] == got[1] == got[2]


def test_repeats_inside_by_force():
    rng = random.Random(3)
    for k in (1, 2, 5, 11, 40):
        rows = ["".join(rng.choice("ACGTN") for _ in range(20)) * 3 if rng.random() < 0.3 else "".join(rng.choice("ACGTN") for _ in range(60)) for _ in range(40)]
        got = repeats_inside(np.frombuffer("".join(rows).encode(), np.uint8).reshape(40, 60), k).tolist()
        assert got == [len({s[i : i + k] for i in range(61 - k)}) < 61 - k for s in rows]


def test_registered_assembly_takes_short_overlaps(spark, monkeypatch):
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(260))
    reads = table(spark, [genome[:100], genome[60:160], genome[159:259]])
    monkeypatch.setattr(registry, "hq", lambda spark, sf: reads)
    assert sorted(map(tuple, registry.QUERIES["assemble_links"](spark, "").select("read_id", "next_id", "overlap").collect())) == [(0, 1, 40), (1, 2, 1)]


def test_division_takes_all_overlaps_of_its_coefficient(spark, monkeypatch):
    rng = random.Random(12)
    genome = "".join(rng.choice("ACGT") for _ in range(64))
    seqs = [genome[at : at + 24] for at in (0, 14, 28, 40)]  # overlaps of 10, 10 and 12 bases; 24 - int(24 * 0.65) + 1 is 10
    asked, found, greedy = [], [], A.greedy_links
    monkeypatch.setattr(A, "both_sides_overlapped", lambda hq, links, n: found.append(C.both_sides_overlapped(hq, links, n)) or found[0])
    monkeypatch.setattr(A, "greedy_links", lambda reads, n, least: asked.append(least) or greedy(reads, n, least if len(asked) == 1 else n - 1))
    A.build(table(spark, seqs), EngineParams(rc_mate2=False, seed=24))
    assert sorted(r.read_id for r in found[0].collect()) == [1, 2]
    assert asked == [10, 1, 1, 1]


@pytest.mark.parametrize("mode,rc", [("se", False), ("pe", True)])
def test_archive_round_trip(spark, tmp_path, mode, rc):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(700))
    back = str.maketrans("ACGTN", "TGCAN")
    seqs, quals = [], []
    for i in range(80):
        at = rng.randrange(0, 640)
        s = genome[at : at + 60]
        if i % 2:
            s = s[::-1].translate(back)
        if i % 7 == 0:
            s = s[:30] + "N" + s[31:]
        seqs.append(s)
        quals.append(("#" if i % 5 == 0 else "I") * 60)
    rows = [(i, i // 2, i % 2, s, q) for i, (s, q) in enumerate(zip(seqs, quals, strict=True))]
    reads = spark.createDataFrame(rows, READS)
    A.compress(reads, str(tmp_path / "a"), EngineParams(mode=mode, rc_mate2=rc, min_overlap=50, seed=24))
    decoded = A.decompress(spark, str(tmp_path / "a"))
    assert A.verify(decoded, reads, mode).first().asDict() == {"wrong": 0, "duplicated": 0, "missing": 0, "surplus": 0, "wrong_pair": 0, "reads": 80}
    assert decoded.where(F.col("seq").contains("N")).count() == sum("N" in s for s in seqs)


def in_order(seqs, least):
    """Links of the descending greedy by force: duplicates, then at each overlap open ends of one key by their ids."""
    n, out, same = len(seqs[0]), [], {}
    for i, s in enumerate(seqs):
        if s in same:
            out.append((same[s], i, n))
        same[s] = i
    first = {s: i for i, s in reversed(list(enumerate(seqs)))}
    tails, heads = sorted(same.values()), sorted(first.values())
    for overlap in range(n - 1, least - 1, -1):
        keys = {}
        for k, ends in enumerate((tails, heads)):
            for i in ends:
                keys.setdefault(seqs[i][n - overlap :] if k == 0 else seqs[i][:overlap], ([], []))[k].append(i)
        pairs = [(a, b, overlap) for x, y in keys.values() for a, b in zip(x, y, strict=False) if a != b]
        out += pairs
        tails, heads = ([i for i in ends if i not in {p[k] for p in pairs}] for k, ends in enumerate((tails, heads)))
    return sorted(out)


@pytest.mark.parametrize("letters,length", [("AC", 9), ("ACGT", 40), ("ACN", 24), ("ACGTRY", 17)])
def test_packed_steps_and_one_task_link_like_text(spark, letters, length):
    rng = random.Random(length)
    genome = "".join(rng.choice(letters) for _ in range(90))
    seqs = [genome[at : at + length] for at in (rng.randrange(0, 90 - length) for _ in range(50))]
    r, want = table(spark, seqs), in_order(seqs, length - 5)
    for rows, part in ((0, 1000), (0, 30), (1000, 1000)):
        assert sorted(map(tuple, O.greedy_links(r, length, length - 5, task_rows=rows, part_rows=part).select("read_id", "next_id", "overlap").collect())) == want


def test_reads_mapped_in_parts_restore(spark, monkeypatch):
    rng = random.Random(15)
    genome = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = [genome[at : at + 40] for at in (rng.randrange(160) for _ in range(24))]
    reads = spark.createDataFrame([(i, i // 2, i % 2, s, ("I" if i % 3 else "#") * 40) for i, s in enumerate(seqs)], READS)
    monkeypatch.setattr(A, "MATCH_ROWS", 5)
    rows, pg, manifest = A.build(reads, EngineParams(ov=0, rc_mate2=False, seed=24))
    decoded = A.restore_rows(rows, pg, manifest["length"], False)
    assert {r.read_id: r.seq for r in decoded.collect()} == dict(enumerate(seqs))


def test_equal_hashes_of_unequal_texts_do_not_link(monkeypatch):
    rng = random.Random(13)
    seqs = ["".join(rng.choice("ACGT") for _ in range(8)) for _ in range(120)]
    codes = list(np.frombuffer("".join(seqs).encode(), np.uint8).reshape(120, 8).T)
    monkeypatch.setattr(O, "MULTIPLIER", 1)  # any order of the same symbols has one hash
    all_ = np.arange(120)
    got = [(a, b, n) for x, y, n in O.rolling_links(codes, all_, all_, all_, 7, 1) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(set(seqs)) == 120 and sorted(got) == in_order(seqs, 1)


def test_contracted_links_cut_and_rank_like_one_task(spark):
    rng = random.Random(14)
    ids = rng.sample(range(1000), 200)
    links, want_cut, want = [], set(), {}
    for size, ring in ((1, True), (2, True), (37, True), (80, False), (60, False), (1, False)):
        part, ids = ids[:size], ids[size:]
        edges = [(a, b, rng.randrange(1, 8)) for a, b in zip(part, part[1:] + part[:1], strict=True)][: size if ring else size - 1]
        cut = min(edges, key=lambda e: (e[2], e[0])) if ring else None
        links += edges
        if ring:
            want_cut.add(cut[0])
            at = part.index(cut[1])
            part = part[at:] + part[:at]
        gap, start = {e[1]: 8 - e[2] for e in edges}, 0
        for rank, x in enumerate(part):
            start += gap[x] if rank else 0
            want[x] = (part[0], rank, start)
    table_ = spark.createDataFrame(links, "read_id long, next_id long, overlap int")
    reads = spark.createDataFrame([(x,) for x in want], "read_id long")
    for rows in (20, 1000):
        cut = L.cut_cycles(table_, task_rows=rows)
        assert {x[0] for x in links} - {x.read_id for x in cut.collect()} == want_cut
        ranks = L.list_ranks(reads, cut, 8, task_rows=rows).collect()
        assert {x.read_id: (x.head, x["rank"], x.start) for x in ranks} == want


def test_reads_are_built_once_and_finished_packed(spark):
    import numpy as np

    from strandloom.operators import overlap as O
    from strandloom.plans import registry

    plan = registry.hq(spark, "/root/testdata/sf0.001").select("read_id", "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("reverse(") == 1 and plan.count("md5(concat(q") <= 3  # not in the filter by class again
    word = np.array([0b00_01_10_11 << 56, 0b11_10_01_00 << 56], np.uint64)
    codes = [O.Symbols(word, np.uint64(62 - 2 * at), np.uint64(3)) for at in range(4)]
    assert [c[np.array([1, 0])].tolist() for c in codes] == [[3, 0], [2, 1], [1, 2], [0, 3]]
    every = np.arange(2)
    assert [(x.tolist(), y.tolist(), n) for x, y, n in O.rolling_links(codes, every, every, every, 3, 1)] == [([0, 1], [1, 0], 1)]


def test_reads_are_packed_in_arrays_as_by_expressions(spark):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from strandloom.operators import overlap as O

    rng = np.random.default_rng(5)
    reads = ["".join(rng.choice(list(letters), 100)) for letters in ("ACGT", "ACGTN") for _ in range(40)]
    for texts in (reads, [*reads, "ACG", "", None, "A" * 120, "é" * 50, "ACGTX"]):
        for bits in (2, 3):
            df = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
            by_text = [F.col("seq").rlike(f"[^{O.ALPHABETS[bits]}]"), *O.packing(F.col("seq"), 100, bits)]
            packed = O.packed_reads(df, 100, bits)
            assert "MapInArrow" in packed._jdf.queryExecution().executedPlan().toString()
            got, want = ([tuple(x) for x in rows.orderBy("read_id").collect()] for rows in (packed, df.select("read_id", *by_text)))
            assert [x[:2] for x in got] == [x[:2] for x in want]
            assert [x for x in got if not x[1]] == [x for x in want if not x[1]]
    part = pa.array(["XX", *reads[:9]]).slice(1)
    assert O.packed_batch(pa.array(range(9)), part, 100, 2).equals(O.packed_batch(pa.array(range(9)), pa.array(reads[:9]), 100, 2))
