"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles. Under each of ``permutations`` hash functions both the least and the
greatest value are kept, so that half the evaluations give the signature; agreement of either is an unbiased
estimate of the Jaccard similarity. Six values make a band: three functions' least and greatest.

1. Documents with one set (by two 64-bit sums of their shingles' hashes) are one class; its smallest id stands for it.
2. Classes that share a band are clustered without comparing all of them: a band's smallest id is its first centre,
   and two bits of each of ``VALUES`` signature values measure the distance from it. Members within ``SETTLED`` of a
   centre need no other one: who is linked to such a member differs from it in ``DIFFER`` values at most, so by the
   triangle inequality it is within ``SETTLED`` and ``DIFFER`` of the centre, and everybody that near joins the
   centre's cluster. The others go on to the next centre. Linked documents that share a band are thus in one cluster.
3. Each cluster's full sets are compared exactly, in blocks of bounded rows and shingles: a search from document to
   document over those not reached yet. A cluster of several blocks has some members in all of them, which join what
   belongs together; then only documents outside its largest component visit the other blocks, chunk by chunk.

No pair is ever a row: a block's task returns each document with its component, or merges of components.

With 135 functions and 45 bands of 6 values a pair at similarity 0.8 shares no band with a probability near 1e-6
(2e-5 for sets of 4 and 5 shingles, whose least and greatest values depend on each other more), and a linked pair
differs in over ``DIFFER`` values about once in ten million.

Cost: a block's search is linear where its documents are linked, and rows times shingles where they are not. A
cluster of m documents of which u are outside its largest component makes m times u / block rows of visits.

Defined cases: null, empty or blank texts have the empty set, no links, and themselves as component; a text of
fewer words than a shingle has its whole word sequence as one shingle; rows that share an id are one document
for links and a row each in the result; a null id has a null component and is kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow_batches, discard, id_text, materialise, read_table, slices, tidy_memory
from .components import connected_components

PERMUTATIONS = 135
BAND = 6  # values: three functions' least and greatest
#: So many values of the signature measure distances, by two bits each.
VALUES = 256
#: Most values in which a linked pair differs: at similarity 0.8 the mean is 38 with a deviation of 5.7.
DIFFER = 70
#: Values in which a member may differ from the centre that settles it. Unrelated documents differ in 192 with a
#: deviation of 7, so SETTLED + DIFFER keeps them apart.
SETTLED = 86
#: Rows and shingles of a block, members that a large cluster has in all of its blocks, and rows that one task may
#: take of a band once its first centre has settled the others.
BLOCK_ROWS, BLOCK_SHINGLES, HUBS, BAND_ROWS = 2048, 1 << 20, 16, 200_000
PLANES = [f"p{k}" for k in range(VALUES // 32)]
PROFILE = "doc_id long, n_shingles long, f0 long, f1 long, " + "".join(f"{p} long, " for p in PLANES) + "bands array<long>"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingles as 64-bit hashes, ascending in each, and where each document begins."""
    lists = [t.lower().split() for t in texts]
    known: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in lists], np.int64)
    total = int(sizes.sum())
    codes, at = np.empty(total, np.int64), 0
    for x in lists:
        codes[at : at + len(x)] = np.fromiter((known.setdefault(w, len(known)) for w in x), np.int64, len(x))
        at += len(x)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, known), np.uint64, len(known))[codes]
    counts = np.where(sizes == 0, 0, np.maximum(1, sizes - words + 1))
    starts = np.append(0, np.cumsum(sizes))
    first = np.repeat(starts[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    limit = starts[1:][doc]
    value = np.full(len(first), _M1)
    for k in range(words):  # a shorter text's only shingle ends where the text does
        here = np.minimum(first + k, limit - 1) if len(first) else first
        value = np.where(first + k < limit, mixed(value * _M2 + h[here] + np.uint64(k + 1)), value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) if len(value) else np.zeros(0, bool)
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _M1)
    return x[:n] | np.uint64(1), x[n:]


def min_max(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Least and greatest under each function, by document: rows of 2n values. Every document has a value."""
    a, b = functions(n)
    out = np.empty((2 * n, len(starts)), np.uint64)
    for k in range(n):
        v = values * a[k] + b[k]
        out[2 * k], out[2 * k + 1] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    return out


def profiles(docs: DataFrame, words: int, permutations: int) -> DataFrame:
    """Size, set fingerprint, signature bits and band keys of each document; ``docs`` as id_text gives it."""
    if 2 * permutations < VALUES or 2 * permutations % BAND:
        raise ValueError(f"need at least {VALUES // 2} functions, and {BAND} to divide twice their number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, cuts = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), words)
            n = np.diff(cuts)
            some = np.flatnonzero(n)
            prints, planes = np.zeros((2, len(n)), np.uint64), np.zeros((len(PLANES), len(n)), np.uint64)
            keys = np.zeros((len(n), 2 * permutations // BAND), np.uint64)
            if len(some):
                starts = cuts[:-1][some]
                prints[0, some] = mixed(np.add.reduceat(mixed(values), starts))
                prints[1, some] = mixed(np.add.reduceat(mixed(values ^ _M2), starts) + n[some].astype(np.uint64))
                s = min_max(values, starts, permutations)
                low = mixed(s[:VALUES])
                for j in range(2):
                    bits = (low >> np.uint64(j)) & np.uint64(1)
                    for part_ in range(VALUES // 64):
                        rows = bits[64 * part_ : 64 * part_ + 64]
                        planes[2 * part_ + j, some] = np.bitwise_or.reduce(rows << np.arange(64, dtype=np.uint64)[:, None], axis=0)
                for band in range(keys.shape[1]):
                    key = np.full(len(some), np.uint64(band + 1)) * _M1
                    for r in range(BAND):
                        key = mixed(key * _M2 + s[BAND * band + r])
                    keys[some, band] = key
            ends = np.append(0, np.cumsum(np.where(n > 0, keys.shape[1], 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].reshape(-1).view(np.int64)))
            columns = [part.column(0), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (*prints, *planes)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PROFILE.split(", ")])

    return docs.mapInArrow(run, PROFILE)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` (doc_id, text, further columns) with each text replaced by its ascending 64-bit hashes, in ``hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, cuts = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), words)
            data, at = values.tobytes(), (cuts * 8).tolist()
            sets = pa.array([data[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), sets, *part.columns[2:]], names=["doc_id", "hashes", *part.schema.names[2:]])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(run, "doc_id long, hashes binary" + more)


def differing(x: str, y: str) -> Column:
    """In how many signature values the planes of structs x and y differ."""
    low, high = PLANES[::2], PLANES[1::2]
    return reduce(add, (F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}")).bitwiseOR(F.col(f"{x}.{q}").bitwiseXOR(F.col(f"{y}.{q}")))) for p, q in zip(low, high, strict=True)))


class Forest:
    """Union and find over 0 to n - 1; the smaller number is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def band_edges(ids: list[int], planes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that put linked members of one band together; ids ascend, planes have a row per member."""
    centres = np.zeros(0, np.int64)
    forest, out = Forest(len(ids)), []
    for x in range(len(ids)):
        apart = planes[centres] ^ planes[x]
        apart = np.bitwise_count(apart[:, ::2] | apart[:, 1::2]).sum(1)
        for c in centres[apart <= SETTLED + DIFFER].tolist():
            if forest.join(c, x):
                out.append((ids[c], ids[x]))
        if not (apart <= SETTLED).any():
            centres = np.append(centres, x)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Sorted rows cut where one of the first ``keys`` columns changes, with whether a run begins."""
    tidy_memory()
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = before != [c[0] for c in columns]
        before = [c[-1] for c in columns]
        cuts = np.flatnonzero(new).tolist()
        if not cuts or cuts[0]:
            cuts = [0, *cuts]
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(i, j - i), bool(new[i])


def settle_bands(rows: DataFrame) -> DataFrame:
    """band_edges of each band; ``rows`` has band, id and the planes, a few per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        planes: list[np.ndarray] = []
        found: list[tuple[int, int]] = []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for part, fresh in runs(batches, 1):
            if fresh and ids:
                found += band_edges(ids, np.concatenate(planes))
                ids, planes = [], []
                if len(found) > 50_000:
                    yield done()
                    found = []
            ids += part.column(1).to_pylist()
            planes.append(np.stack([part.column(k).to_numpy().view(np.uint64) for k in range(2, 2 + len(PLANES))], axis=1))
        if ids:
            found += band_edges(ids, np.concatenate(planes))
        yield done()

    return rows.select("band", "id", *PLANES).repartition("band").sortWithinPartitions("band", "id").mapInArrow(run, "a long, b long")


def clusters_of(reps: DataFrame) -> DataFrame:
    """node, label (of its cluster) for each class that shares a band with a class like it."""
    banded = reps.select(F.explode("bands").alias("band"), F.col("rep").alias("id"))
    # joins of tables that grow with the corpus are sort-merge joins at every size
    several = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").hint("merge")
    planes = reps.select(F.col("rep").alias("id"), *PLANES)
    open_ = materialise(banded.join(several, "band", "left_semi").join(planes.hint("merge"), "id"), "bands")
    edges, stored = [], [open_]
    while True:
        first = open_.groupBy("band").agg(F.min(F.struct("id", *PLANES)).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "c")
        measured = open_.select("band", "id", F.struct(*PLANES).alias("m")).join(first.hint("merge"), "band").select("band", "id", "m", F.col("c.id").alias("centre"), differing("m", "c").alias("d"))
        measured = materialise(measured, "measured")
        stored.append(measured)
        edges.append(measured.where((F.col("id") != F.col("centre")) & (F.col("d") <= SETTLED + DIFFER)).select(F.col("centre").alias("a"), F.col("id").alias("b")))
        open_ = measured.where(F.col("d") > SETTLED).select("band", "id", "m.*")
        most = open_.groupBy("band").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= BAND_ROWS:
            break
    if most > 1:
        edges.append(settle_bands(open_))
    clusters = connected_components(reduce(DataFrame.unionByName, edges).distinct())
    discard(*stored)
    return clusters


class Block:
    """Shingle sets, to be compared with one at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes, self.ends = codes.astype(np.int32), np.cumsum(self.sizes)
        self.mark = np.zeros(len(self.known), bool)
        self.keep(np.arange(len(sets)))

    def own(self, x: int) -> np.ndarray:
        return self.codes[self.ends[x] - self.sizes[x] : self.ends[x]]

    def keep(self, rows: np.ndarray) -> None:
        """Compare only with these rows from now on."""
        n = self.sizes[rows]
        self.rows, self.starts = rows, np.cumsum(n) - n
        self.flat = self.codes[np.repeat(self.ends[rows] - n - self.starts, n) + np.arange(int(n.sum()))]

    def similar(self, codes: np.ndarray, size: int, threshold: int) -> np.ndarray:
        """Which of the kept rows are linked to a set of this size that has these codes."""
        self.mark[codes] = True
        both = np.add.reduceat(self.mark[self.flat], self.starts, dtype=np.int64)
        self.mark[codes] = False
        return (100 * both >= threshold * (self.sizes[self.rows] + size - both)) & (both > 0)


def block_components(sets: list[np.ndarray], threshold: int) -> list[int]:
    """The first member of each set's component; sets are not empty."""
    block, n = Block(sets), len(sets)
    group = np.full(n, -1)
    waiting = np.ones(n, bool)
    for seed in range(n):
        if group[seed] >= 0:
            continue
        group[seed], waiting[seed], queue = seed, False, [seed]
        while queue and waiting.any():
            left = waiting[block.rows]
            if 2 * left.sum() < len(left):
                block.keep(block.rows[left])
            x = queue.pop()
            hit = block.rows[block.similar(block.own(x), int(block.sizes[x]), threshold)]
            hit = hit[waiting[hit]]
            group[hit], waiting[hit] = seed, False
            queue += hit.tolist()
    return group.tolist()


def set_of(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint64)


def compare_blocks(rows: DataFrame, threshold: int) -> DataFrame:
    """node, label (least id of its component in the block), for each row of cluster, block, doc_id, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        out: tuple[list[int], list[int]] = [], []

        def settle() -> None:
            forest = Forest(len(ids))
            for k, g in enumerate(block_components(sets, threshold)):
                forest.join(k, g)
                if k and ids[k] == ids[k - 1]:
                    forest.join(k, k - 1)
            out[0].extend(ids)
            out[1].extend(ids[forest.root(k)] for k in range(len(ids)))  # ids ascend, and roots are first members

        for part, fresh in runs(batches, 2):
            if fresh and ids:
                settle()
                ids, sets = [], []
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "label"])
                    out = [], []
            for x, cell in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                s = set_of(cell)
                if len(s) and not (ids and ids[-1] == x and np.array_equal(sets[-1], s)):
                    ids.append(x)
                    sets.append(s)
        if ids:
            settle()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "label"])

    dealt = rows.select("cluster", "block", "doc_id", "hashes").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "doc_id", "hashes")
    return dealt.mapInArrow(run, "node long, label long")


def compare_visitors(rows: DataFrame, threshold: int) -> DataFrame:
    """a, b: labels that a link joins; rows are cluster, block, chunk, visits, label, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []
        sets: list[np.ndarray] = []
        block: Block | None = None
        number: dict[int, int] = {}
        forest = Forest(0)
        out: tuple[list[int], list[int]] = [], []
        for part, fresh in runs(batches, 3):
            if fresh:
                labels, sets, block, number, forest = [], [], None, {}, Forest(0)
            for visits, label, cell in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5), strict=True):
                s = set_of(cell)
                if label not in number:
                    number[label] = len(forest.up)
                    forest.up.append(len(forest.up))
                if not visits and sets and labels[-1] == label and np.array_equal(sets[-1], s):
                    continue
                if not visits:
                    labels.append(label)
                    sets.append(s)
                elif sets:
                    block = block or Block(sets)
                    at = np.minimum(np.searchsorted(block.known, s), len(block.known) - 1)
                    hit = block.similar(at[block.known[at] == s], len(s), threshold)
                    for other in {labels[k] for k in np.flatnonzero(hit).tolist()}:
                        if forest.join(number[label], number[other]):
                            out[0].append(label)
                            out[1].append(other)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
                out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    keys = ["cluster", "block", "chunk"]
    dealt = rows.select(*keys, "visits", "label", "hashes").repartition(*keys).sortWithinPartitions(*keys, "visits", "label", "hashes")
    return dealt.mapInArrow(run, "a long, b long")


def linked(texts: DataFrame, reps: DataFrame, words: int, threshold: int, block_rows: int) -> DataFrame:
    """node, label: the component of each class that has a link; classes alone may be missing."""
    member = clusters_of(reps).select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))
    sized = member.join(reps.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    sizes = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), blocks.cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    placed = materialise(member.join(sizes, "cluster").select("doc_id", "cluster", "m", "blocks", own.alias("block")).distinct(), "members")
    large = placed.where("blocks > 1")
    some = large.limit(1).count() > 0

    sets = full_sets(texts.join(placed.hint("merge"), "doc_id").select("doc_id", "text", "cluster", "m", "blocks", "block"), words)
    if not some:
        return materialise(compare_blocks(sets, threshold).distinct(), "labels")
    sets = materialise(sets.where(F.length("hashes") > 0), "sets")
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("m")) < HUBS)
    everywhere = F.when(hub, F.expr("sequence(0, blocks - 1)")).otherwise(F.array("block"))
    found = materialise(compare_blocks(sets.withColumn("block", F.explode(everywhere)), threshold).distinct(), "labels")
    mine = found.join(large.select(F.col("doc_id").alias("node")), "node", "left_semi")
    joined = connected_components(mine.select(F.col("node").alias("a"), F.col("label").alias("b")))
    # documents of large clusters: their components so far, and who visits whom
    labels = large.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "cluster", "blocks", F.coalesce("label", "doc_id").alias("label"))
    labels = materialise(labels, "labels")
    counts = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("out")).where("out > 0")
    main = main.select("cluster", "main", F.ceil(F.col("out") / block_rows).cast("int").alias("chunks"))
    told = sets.drop("m", "blocks").join(labels.select("doc_id", "label", "blocks"), "doc_id").join(main, "cluster")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("chunks")).cast("int")
    home = told.select("cluster", "block", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(0).alias("visits"), "label", "hashes")
    away = told.where("label <> main").select("cluster", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), chunk.alias("chunk"), F.lit(1).alias("visits"), "label", "hashes")
    merges = materialise(compare_visitors(home.unionByName(away), threshold), "merges")
    last = connected_components(merges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    whole = labels.join(last, "label", "left").select(F.col("doc_id").alias("node"), F.coalesce("to", "label").alias("label"))
    alone = found.join(large.select(F.col("doc_id").alias("node")), "node", "left_anti")
    return materialise(alone.unionByName(whole), "labels")


def with_shared_ids(labels: DataFrame, known: DataFrame, reps: DataFrame) -> DataFrame:
    """Labels after joining the classes of rows that share an id."""
    of_set = F.struct("f0", "f1")
    several = known.groupBy("doc_id").agg(F.min(of_set).alias("lo"), F.max(of_set).alias("hi")).where("lo <> hi").select("doc_id")
    rows = known.join(several, "doc_id", "left_semi").select("doc_id", "f0", "f1", "n_shingles").distinct()
    classes = materialise(rows.join(reps, ["f0", "f1", "n_shingles"]).select("doc_id", "rep"), "shared-ids")
    if not classes.limit(1).count():
        return labels
    least = classes.groupBy("doc_id").agg(F.min("rep").alias("a"))
    edges = classes.join(least, "doc_id").select("a", F.col("rep").alias("b"))
    return connected_components(edges.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80, permutations: int = PERMUTATIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; ``threshold`` is in hundredths, 80 or more."""
    if threshold < 80:
        raise ValueError("the bands and the distances are made for a similarity of 0.8 or more")
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    texts = id_text(docs, id_col, text_col)
    profile = materialise(profiles(texts, words, permutations), "profiles")
    known = profile.where("doc_id IS NOT NULL AND n_shingles > 0")
    one = F.min_by(F.struct(F.col("doc_id").alias("rep"), "bands", *PLANES), "doc_id").alias("r")
    reps = materialise(known.groupBy("f0", "f1", "n_shingles").agg(one).select("f0", "f1", "n_shingles", "r.*"), "classes")
    labels = with_shared_ids(linked(texts, reps, words, threshold, block_rows), known, reps)
    set_key = ["f0", "f1", "n_shingles"]
    component = reps.join(labels, reps["rep"] == labels["node"], "left").select(*set_key, F.coalesce("label", "rep").alias("component"))
    rows = profile.select("doc_id", "n_shingles", "f0", "f1").join(component.hint("merge"), set_key, "left")
    of = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", of.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, threshold=80)
