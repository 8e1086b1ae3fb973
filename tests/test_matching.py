"""Matches on a text in chunks are those on its positions."""

import random
import re

from strandloom.operators import matching as M


def test_chunks_match_like_positions(spark):
    rng = random.Random(21)
    n, chunk = 40, 64
    text = "".join(rng.choice("ACGT") for _ in range(64 * 3 + 11))
    text = text[:150] + text[20:75] + text[:12]
    back = str.maketrans("ACGT", "TGCA")
    reads = []
    for i, at in enumerate([0, 24, 25, 60, 63, 64, 110, len(text) - n, len(text) - n, 150] + [rng.randrange(len(text) - n) for _ in range(40)]):
        s = list(text[at : at + n])
        for _ in range(i % 4):
            s[rng.randrange(n)] = "N"
        reads.append((i, "".join(s)[::-1].translate(back) if i % 2 else "".join(s)))
    reads += [(90, text[-25:] + "ACGTTGCAACGTTGC"), (91, "".join(rng.choice("ACGT") for _ in range(n)))]
    rows = spark.createDataFrame(reads, "read_id long, seq string")
    whole = spark.createDataFrame([(p, text[p : p + n]) for p in range(len(text) - n + 1)], "pos long, txt string")
    chunks = spark.createDataFrame([(c, c * chunk, text[c * chunk : c * chunk + chunk + n - 1]) for c in range(-(-len(text) // chunk))], "chunk long, start long, seq string")
    want = sorted(map(tuple, M.sampled(rows, whole, n, 13, 24).collect()))
    assert sorted(map(tuple, M.sampled_in_chunks(rows, chunks, n, 13, 24, chunk=chunk).collect())) == want
    assert len(want) > 30


def test_exact_matches_come_first_and_the_rest_alike(spark, monkeypatch):
    from strandloom.plans import archive as A

    rng = random.Random(23)
    n, chunk = 48, M.CHUNK
    text = "".join(rng.choice("ACGT") for _ in range(chunk + 300))
    text = text[:700] + text[90:190] + text[700:] + text[20:75]
    back = str.maketrans("ACGT", "TGCA")
    reads = []
    for i in range(120):
        at = rng.choice([0, 95, 120, chunk - 40, chunk - n, chunk, len(text) - n, rng.randrange(len(text) - n)])
        s = list(text[at : at + n])
        for _ in range(i % 3):
            s[rng.randrange(n)] = rng.choice("ACGTN")
        reads.append((i, "".join(s)[::-1].translate(back) if i % 2 else "".join(s)))
    rows = spark.createDataFrame(reads, "read_id long, seq string")
    whole = spark.createDataFrame([(p, text[p : p + n]) for p in range(len(text) - n + 1)], "pos long, txt string")
    chunks = spark.createDataFrame([(c, c * chunk, text[c * chunk : c * chunk + chunk + n - 1]) for c in range(-(-len(text) // chunk))], "chunk long, start long, seq string")
    want = sorted(map(tuple, M.sampled(rows, whole, n, 16, 38).collect()))
    asked, keep = [], M.sampled_in_chunks
    monkeypatch.setattr(A, "sampled_in_chunks", lambda r, *a, **b: (asked.append(r.count()), keep(r, *a, **b))[1])
    assert sorted(map(tuple, A.mapped_in_parts(rows, chunks, n, 16, 38, None).collect())) == want
    exact = sum(w[3] == 0 for w in want)
    assert 40 < exact < len(want) and asked[1:] == [120 - exact]  # the text is looked through again for the others only
    assert sorted(map(tuple, A.mapped_in_parts(rows, chunks, n, 16, 38, 10_000).collect())) == want
    # pairs whose hashes are equal are compared as text: all hashes alike give the same rows
    monkeypatch.setattr(M, "VALUES", M.VALUES * M.np.uint64(0))
    few = spark.createDataFrame(reads[:30], "read_id long, seq string")
    short = spark.createDataFrame([(0, 0, text[:400])], "chunk long, start long, seq string")
    want = sorted(map(tuple, M.sampled(few, whole.where("pos <= 352"), n, 16, 38).collect()))
    assert sorted(map(tuple, keep(few, short, n, 16, 38).collect())) == want and want


def test_exact_match_shuffles_no_position_as_text(spark, monkeypatch):
    rng = random.Random(22)
    n, chunk = 40, 64
    text = "".join(rng.choice("ACGT") for _ in range(64 * 3 + 11))
    text = text[:130] + text[20:75] + text[:12] + text[20:75]
    back = str.maketrans("ACGT", "TGCA")
    reads = [(i, text[p : p + n][::-1].translate(back) if i % 2 else text[p : p + n]) for i, p in enumerate([0, 24, 63, 64, 110, 130, 131, len(text) - n, len(text) - n] + [rng.randrange(len(text) - n) for _ in range(30)])]
    reads += [(90, "N" + text[1:n]), (91, text[-25:] + "ACGTTGCAACGTTGC"), (92, text[:20] + text[:20])]
    rows = spark.createDataFrame(reads, "read_id long, seq string")
    whole = spark.createDataFrame([(p, text[p : p + n]) for p in range(len(text) - n + 1)], "pos long, txt string")
    chunks = spark.createDataFrame([(c, c * chunk, text[c * chunk : c * chunk + chunk + n - 1]) for c in range(-(-len(text) // chunk))], "chunk long, start long, seq string")
    want = sorted(map(tuple, M.exact(rows, whole).collect()))
    assert sorted(map(tuple, M.exact_in_chunks(rows, chunks, n, chunk).collect())) == want and len(want) == len(reads) - 3
    # pairs of one hash are compared as text: all hashes alike give the same rows
    with monkeypatch.context() as m:
        m.setattr(M.F, "xxhash64", lambda *_: M.F.lit(7).cast("long"))
        assert sorted(map(tuple, M.exact_in_chunks(rows, chunks, n, chunk).collect())) == want
    wrote = []
    keep = M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df, name, *by: (wrote.append(df._jdf.queryExecution().toString()), keep(df, name, *by))[1])
    from strandloom.plans import registry

    registry.QUERIES["exact_match"](spark, "/root/testdata/sf0.001")
    assert re.search(r"Join Inner, \(h#\d+L = h#\d+L\)", wrote[0]) and "txt#" not in wrote[0]
