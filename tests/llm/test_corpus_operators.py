"""Operators over the whole corpus: duplicates, repeats, search, classifier, archives, pipeline."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from brute import bm25, components, repeats
from pyspark.sql import functions as F

from strandloom.llm import near_dedup as ND
from strandloom.llm import quality_model as QM
from strandloom.llm import topk_search as TS
from strandloom.llm import warc as WA
from strandloom.llm.components import connected_components
from strandloom.llm.substring_dedup import PIECE, SuffixLevels, remove_repeats, stretches

SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, kept int, band string")


def family(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(80)]
    rows = [(None, "null id text here"), (90, None), (91, ""), (92, " \n"), (93, "one"), (94, "one"), (95, "ONE"), (96, "x y"), (96, "x y"), (97, "z " * 3000)]
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(50 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(10)]
    rows += [(70, rows[15][1]), (71, rows[15][1].upper())]
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rows = family()
    want = sorted(zip([d for d, _ in rows], components(rows, words, 80), strict=True), key=repr)
    got = sorted(((r.doc_id, r.component_id) for r in ND.near_duplicates(documents(spark, rows), words=words).collect()), key=repr)
    assert got == want
    assert ND.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_near_duplicates_of_one_id_and_over_several_blocks(spark):
    rows = family(2)
    rows += [(3, rows[-9][1]), (200, rows[20][1] + " tail"), (200, rows[-8][1]), (200, rows[-8][1])]
    want = sorted(zip([d for d, _ in rows], components(rows, 2, 80), strict=True), key=repr)
    got = sorted(((r.doc_id, r.component_id) for r in ND.near_duplicates(documents(spark, rows), words=2, block_rows=4).collect()), key=repr)
    assert got == want


def test_bands_keep_linked_members_together():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, len(ND.PLANES), dtype=np.uint64)
    # members drift from the first: neighbours differ in few values, the ends in most
    planes = [base]
    for _ in range(60):
        flip = np.zeros(64 * len(ND.PLANES), np.uint64)
        flip[r.integers(0, len(flip), 30)] = 1
        planes.append(planes[-1] ^ np.bitwise_or.reduce(flip.reshape(-1, 64) << np.arange(64, dtype=np.uint64), axis=1))
    order = r.permutation(61)
    rows = np.stack(planes)[order]
    forest = ND.Forest(61)
    for a, b in ND.band_edges(list(range(61)), rows):
        forest.join(a, b)
    apart = rows[:, None] ^ rows[None]
    apart = np.bitwise_count(apart[:, :, ::2] | apart[:, :, 1::2]).sum(2)
    near = np.argwhere(apart <= ND.DIFFER)
    assert len(near) > 61 and all(forest.root(int(a)) == forest.root(int(b)) for a, b in near)


def test_min_max_estimates_similarity():
    r = np.random.default_rng(1)
    both, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    values = np.concatenate([np.sort(np.append(both, a)), np.sort(np.append(both, b))])
    s = ND.min_max(ND.mixed(values), np.array([0, 900]), 135)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.8) < 0.1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)], "a long, b long")
    assert {(r.node, r.label) for r in connected_components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_components_of_a_shuffled_path(spark):
    ids = list(range(800))
    random.Random(4).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(1000, 1001), (1002, 1001)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert connected_components(links.where("a > 5000")).count() == 0


def repeat_rows():
    r = random.Random(3)
    passage = "".join(r.choice("abcd é") for _ in range(140))
    line = "Licensed under these very plain and common terms, all of them."
    rows = [(None, passage * 2), (0, None), (1, ""), (2, "short")]
    for i in range(3, 40):
        a, b = sorted(r.randrange(0, 140) for _ in range(2))
        rows.append((i, "".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 90))) + passage[a:b] + line[r.randrange(9) :] + str(i) + passage[:a]))
    rows += [(60, rows[10][1]), (61, rows[10][1]), (61, rows[10][1]), (5, rows[10][1]), (62, "é" * 400), (63, "é" * 300)]
    return rows


@pytest.mark.parametrize("length", [50, 64])
def test_repeats(spark, length):
    rows = repeat_rows()
    want = []
    for (d, t), mask in zip(rows, repeats(rows, length), strict=True):
        data = (t or "").encode()
        runs = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        want.append((d, len(data), sum(mask), runs, bytes(x for x, m in zip(data, mask, strict=True) if not m)))
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in remove_repeats(documents(spark, rows), length=length).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert remove_repeats(documents(spark, []).limit(0)).count() == 0


def test_repeats_of_a_stretch_that_its_first_document_has_often(spark):
    r = random.Random(21)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, head, tail = some(60), some(40), some(40)
    often = some(80).join([head + passage + tail] * 3)
    rows = [(1, some(30) + passage + some(30)), (5, often + some(20)), (5, some(10) + head + passage + tail), (7, often)]
    masks = repeats(rows, 50)
    got = [(row.doc_id, sum(s.end - s.start for s in row.spans), len(row.spans)) for row in remove_repeats(documents(spark, rows)).collect()]
    want = [(d, sum(mask), sum(m > (i and mask[i - 1]) for i, m in enumerate(mask))) for (d, _), mask in zip(rows, masks, strict=True)]
    assert want[1][2] == 3 and sorted(got) == sorted(want)


def test_stretches_that_share_half_a_hash_are_kept(spark):
    a, b = "bkzmrxxjgvroqqignmwosmpqepozttmycetzzmhbphmliwfikp", "sddmggbtouixjdoqtmwosmpqepozttmychafzxkkcsmcrztufc"
    _, _, _, low, whole, again = stretches([a.encode(), b.encode()], 50, 16)
    half = np.uint64(0xFFFFFFFF)
    assert low[0] == low[1] and whole[0] & half == whole[1] & half and whole[0] != whole[1]
    rows = [(1, a), (2, b), (3, "x" + a + "y")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: [(1, 51)]}


def test_frequent_minimizers_are_dealt_by_window(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    phrase = "".join(r.choice(letters) for _ in range(45))
    rows = [(i, "".join(r.choice(letters) for _ in range(40)) + phrase + "".join(r.choice(letters) for _ in range(40))) for i in range(60)]
    rows += [(60 + i, rows[i][1][20:110]) for i in range(20)] + [(90, phrase * 3), (91, "x" + phrase * 3)]
    texts = [t.encode() for _, t in rows]
    low, n = np.unique(stretches(texts, 50, 16)[3], return_counts=True)
    hot = np.sort(low[n >= 20])
    assert len(hot)
    d, start, count, key, _, _ = stretches(texts, 50, 16, hot)
    windows = sorted((int(a), int(s) + k) for a, s, c in zip(d, start, count, strict=True) for k in range(c))
    assert windows == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 49)] and not np.isin(key, hot).any()
    masks = repeats(rows, 50)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in remove_repeats(documents(spark, rows), hot_rows=20).collect()}
    for (i, _), mask in zip(rows, masks, strict=True):
        assert [k for a, b in got[i] for k in range(a, b)] == [k for k, m in enumerate(mask) if m]


def test_stretches_cover_each_window_once():
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab ") for _ in range(n)) for n in (0, 49, 50, 51, 400)]
    d, start, count, low, _, _ = stretches(texts, 50, 16)
    windows = sorted((int(a), int(s) + k) for a, s, c in zip(d, start, count, strict=True) for k in range(c))
    assert windows == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 49)]


def test_stretches_of_a_slice_and_of_a_long_text_take_little_memory():
    r = random.Random(12)
    words = [bytes(r.choice(b"abcdefgh ") for _ in range(30)) for _ in range(500)]
    long = b"".join(r.choice(words) for _ in range(100_000))
    for texts in ([long], [long[i : i + 2000] for i in range(0, 2 << 20, 2000)]):
        tracemalloc.start()
        d, start, count, *_ = stretches(texts, 50, 16)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6
        assert count.sum() == sum(len(t) - 49 for t in texts if len(t) > 49)
        same = d[1:] == d[:-1]
        assert (start[1:][same] == (start + count)[:-1][same]).all()


def test_repeat_across_the_cut_of_a_long_text(spark):
    r = random.Random(13)
    long = "".join(r.choice("abcdefgh ") for _ in range(PIECE + 1000))
    rows = [(1, long[PIECE - 150 : PIECE + 150]), (2, long), (3, "x" * 60 + long[PIECE - 40 : PIECE + 40])]
    got = {row.doc_id: [(s.start, s.end) for s in row.spans] for row in remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: [], 2: [(PIECE - 150, PIECE + 150)], 3: [(60, 140)]}


def test_suffix_levels_grow_geometrically():
    r = random.Random(2)
    family_, seen = SuffixLevels(4), {}
    for doc in range(60):
        text = bytes(r.choice(b"a\x00c") for _ in range(r.randrange(4, 40)))
        keys = [text[i : i + 4] for i in range(len(text) - 3)]
        got = family_.match(np.frombuffer(text, np.uint8), np.arange(len(keys)), np.full(len(keys), doc))
        assert got.tolist() == [seen.get(k, doc) < doc for k in keys]
        for k in keys:
            seen.setdefault(k, doc)
    for level in family_.levels:
        keys = [bytes(level.text[i : i + 4]) for i in level.starts]
        assert keys == sorted(set(keys)) and all(seen[k] <= d for k, d in zip(keys, level.docs, strict=True))
    sizes = [len(x.starts) for x in family_.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_top_k(spark):
    r = random.Random(6)
    words = [f"t{int(r.paretovariate(0.7)) % 400}" for _ in range(6000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(260)]
    rows += [(300, None), (301, rows[0][1]), (302, rows[0][1]), (None, rows[0][1])]
    docs = documents(spark, rows)
    got = {}
    for x in TS.top_k(docs, docs.where("doc_id % 20 = 0"), 7, shard_bytes=4000).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((-x.score, x.doc_id))
    known = [x for x in rows if x[0] is not None]
    for d, t in known:
        if d % 20 == 0 and t:
            want = bm25(known, t, 7, TS.STRIP)
            assert [x[1] for x in got[d]] == [x[1] for x in want]
            assert np.allclose([x[0] for x in got[d]], [x[0] for x in want], atol=2e-6)
    assert TS.top_k(docs.limit(0), docs).count() == 0


def test_search_many_queries_at_once(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(r.paretovariate(0.8)) % 300}" for _ in range(r.randrange(1, 80)))) for i in range(1200)]
    folder = TS.new_path(spark, "postings")
    parts = TS.build_shards(TS.id_text(documents(spark, rows)).repartition(4), folder, 1 << 20).collect()
    term, owner, count = TS.terms_of([t.encode() for _, t in rows[:100]])
    df = np.array([sum(dict(zip(p.terms, p.df, strict=True)).get(t, 0) for p in parts) for t in term.view(np.int64).tolist()])
    order = np.argsort(owner, kind="stable")
    asked = TS.Asked(np.arange(100), np.bincount(owner), term[order], (count * np.log(1 + (1200 - df + 0.5) / (df + 0.5)))[order], 5)
    opened = []
    for p in parts:
        files, base = TS.open_fs(folder)
        with files.open_input_stream(f"{base}/{p.name}", compression=None) as held:
            shard = TS.Shard(held.read(), sum(p.total for p in parts) / 1200)
        shard.search(asked)
        opened.append(shard.opened / (100 * shard.blocks))
    assert len(parts) == 4 and opened[0] == 1 and max(opened[1:]) < 0.75  # then blocks of the other language are passed over
    for i in range(100):
        want = bm25(rows, rows[i][1], 5, TS.STRIP)
        assert asked.doc[i].tolist() == [x[1] for x in want]
        assert np.allclose(-asked.score[i], [x[0] for x in want], atol=2e-6)


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet")
    known, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    out = QM.classify_quality(docs.join(labels.select("doc_id"), "doc_id"), known).select("doc_id", "kept").join(held, "doc_id")
    c = {(r.clean, r.kept): r.n for r in out.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"), "kept").agg(F.count("*").alias("n")).collect()}
    assert c.get((True, False), 0) <= 0.01 * c[True, True]
    assert c[False, False] >= 0.9 * (c[False, False] + c.get((False, True), 0))


def test_classifier_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "tie"), (3, "tie"), (4, "q " * 4000)]
    assert QM.classify_quality(documents(spark, rows)).count() == 6
    assert QM.classify_quality(documents(spark, []).limit(0)).count() == 0


def test_label_model_finds_accuracies():
    r = np.random.default_rng(3)
    bad = r.random(4000) < 0.2
    right = [0.9, 0.8, 0.7]
    votes = np.stack([np.where(r.random(4000) < p, ~bad, bad).astype(int) for p in right] + [np.where(r.random(4000) < 0.2, ~bad, QM.NONE).astype(int)], 1)
    m = QM.LabelModel(4).fit(votes, np.ones(4000))
    assert np.allclose([m.table[k, 0, 0] for k in range(3)], right, atol=0.06)
    assert abs(m.prior_bad - 0.2) < 0.04


def test_warc(spark, tmp_path):
    big = "<p>é" + "x" * 2000
    rows = [(1, "http://a/ü\r\n", big), (5, None, big), (3, "u", big), (4, "u", None), (6, "u", "small"), (7, "u", "small"), (None, "u", "null id"), (9, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int")
    files = WA.write_archives(pages, f"file://{tmp_path}/w", file_bytes=3000)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == big and i != 5
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None))
    for split in (64, 1000, 1 << 24):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in WA.read_archives(files, split).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert WA.read_archives(WA.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} <= ids and len(rows) > len(ids) // 2, name
        if name == "near_dedup":
            kept = docs.collect()
            parts = components([(r.doc_id, r.text) for r in kept], 5, 80)
            assert {r.doc_id for r in rows} == {r.doc_id for r, c in zip(kept, parts, strict=True) if r.doc_id == c}
        if name == "repeats":
            before = {r.doc_id: r.text for r in docs.collect()}
            masks = dict(zip(before, repeats(list(before.items()), cp.REPEAT_BYTES), strict=True))
            for r in rows:
                left = bytes(x for x, m in zip(before[r.doc_id].encode(), masks[r.doc_id], strict=True) if not m)
                assert r.text == left.decode("utf-8", "ignore")
        docs, ids = spark.createDataFrame(rows, docs.schema), {r.doc_id for r in rows}
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids
