"""Exact top-k BM25 search over a sharded inverted index with block-max WAND pruning.

Documents are indexed shard by shard, a shard being what a task gathers up to ``shard_bytes`` of text or
``SHARD_ROWS`` documents: terms with their postings in order of documents, alike documents (by frequent terms, so by
language above all) side by side, cut into blocks of ``BLOCK`` documents. Lengths and document frequencies are summed
over all shards, so that every shard scores with the same statistics and the merged lists are the exact answer.

Queries run in a shard as block-max WAND, many at once with arrays instead of one cursor per list. A query's threshold
is its k-th best score so far, carried from shard to shard of a task. Its rare lists, which can add most a posting,
come before the pivot: their postings are added up document by document. Its frequent lists come from the pivot on:
they are bounded by the greatest impact in each block, for all queries and blocks as one product of matrices. A block
in which the best document's sum and that bound stay below the threshold is passed over. In the blocks left the frequent
lists, kept as rows of a matrix, are added as products of matrices. Nothing that could reach the first k is skipped,
ties included; which lists count as frequent changes the time only.

Shards and queries lie in the shared folder. A task takes one chunk of about ``CHUNK_ROWS`` queries and at most
``TASK_SHARDS`` shards, one after the other, so its work does not grow with the corpus; the number of tasks does, with
its square, as every query meets every shard.

Defined cases: null or empty texts are documents without terms, never found; a very long text is a shard of its own;
a query without terms finds nothing; rows that share an id are separate documents, and one query with their terms
together; a null id is not found and asks nothing; fewer than k matches give fewer rows; ties go to the smaller id;
an empty table of documents or queries gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bound_arrow_batches, id_text, materialise, new_path, read_table, slices, tidy_memory
from .substring_dedup import first_of_runs, pack, unpack
from .warc import open_fs

K1, B = 1.2, 0.75
#: Documents of a block.
BLOCK = 64
SHARD_BYTES, SHARD_ROWS = 32 << 20, 1 << 16
CHUNK_ROWS = 2048
#: Terms of queries that are searched together, 24 bytes each; a longer query is searched alone.
CHUNK_TERMS = 1 << 21
#: Shards of a task at most, and tasks that are wanted before a task gets more than one.
TASK_SHARDS, TASKS = 16, 96
#: A list is frequent if it has this part of a shard's documents; at most so many lists, and cells of their matrix.
FREQUENT, LISTS, CELLS = 0.04, 1024, 8 << 20
#: Scores, documents by queries, that are held at once; queries at most.
SCORES, BATCH = 1 << 21, 256
#: Blocks that are added as one product, for those queries that any of them is left to.
RUN = 8
#: Scores are compared with this slack and reported to six decimals, so that the order of sums does not matter.
SLACK = 1e-6
STRIP = b".,;:!?\"'()[]{}"


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hash, text number and count of all different terms, ordered by term and text."""
    n, codes, owners = max(1, len(texts)), [pa.array([], pa.utf8()).dictionary_encode()], [np.zeros(0, np.int32)]
    ends = np.cumsum([len(t) for t in texts])
    first = 0
    while first < len(texts):  # by slices, so that few words are held as text
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - len(texts[first]) + SLICE_BYTES, side="right")))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts[first:last], pa.binary()).view(pa.utf8())))
        codes.append(words.flatten().dictionary_encode())
        owners.append(np.repeat(np.arange(first, last, dtype=np.int32), pc.list_value_length(words).to_numpy()))
        first = last
    chunks = pa.chunked_array(codes).unify_dictionaries().chunks
    known = chunks[0].dictionary.view(pa.binary())
    digest, nothing = xxhash.xxh3_64_intdigest, np.uint64(xxhash.xxh3_64_intdigest(b""))
    hashes, rank = np.unique(np.fromiter((digest(w.as_py().strip(STRIP)) for w in known), np.uint64, len(known)), return_inverse=True)
    key = rank[np.concatenate([c.indices.to_numpy() for c in chunks])]
    codes = chunks = known = words = None
    pa.default_memory_pool().release_unused()
    empty = key == np.searchsorted(hashes, nothing) if nothing in hashes else None
    key *= n
    key += np.concatenate(owners)
    if empty is not None:
        key = key[~empty]
    key.sort()
    at = np.flatnonzero(first_of_runs(key))
    term, owner = np.divmod(key[at], n)
    return hashes[term], owner, np.diff(np.append(at, len(key)))


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def alike(n: int, at: np.ndarray, df: np.ndarray, docs: np.ndarray, count: np.ndarray, groups: int = 8) -> np.ndarray:
    """A group number for each of n documents, by a few rounds of k-means over the most frequent lists."""
    if not len(df):
        return np.zeros(n, np.int64)
    f = np.argsort(-df, kind="stable")[: max(1, min(256, (1 << 21) // n))]
    i = spread(at[f], df[f])
    x = np.zeros((n, len(f)), np.float32)
    x[docs[i], np.repeat(np.arange(len(f)), df[f])] = np.log2(1 + count[i])
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    x = unit(x)
    centre = x[[n // 2]]
    for _ in range(groups - 1):  # the document that is least like the centres so far
        centre = np.vstack([centre, x[[(x @ centre.T).max(1).argmin()]]])
    for _ in range(6):
        group = (x @ centre.T).argmax(1)
        centre = unit(np.stack([x[group == g].mean(0) if (group == g).any() else centre[g] for g in range(groups)]))
    return group


def build_shards(docs: DataFrame, folder: str, shard_bytes: int) -> DataFrame:
    """One row per shard: documents, total length, terms with their document frequencies, and the file of its postings.

    A file has a fresh name, so that only files of tasks that succeeded are listed.
    """
    schema = "n_docs long, total long, terms array<long>, df array<long>, name string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def emit() -> pa.RecordBatch:
            term, owner, count = terms_of(texts)
            texts.clear()
            length = np.bincount(owner, count, len(ids)).astype(np.int64)
            at = np.flatnonzero(first_of_runs(term))
            df = np.diff(np.append(at, len(term)))
            # alike documents share blocks, and in a group those of like length, so that block maxima are closer
            order = np.lexsort((length, alike(len(ids), at, df, owner, count)))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # lists go by falling length, so that those that most queries read lie together
            slot, by_size = np.empty(len(at), np.int64), np.argsort(-df, kind="stable")
            slot[by_size] = np.arange(len(at))
            inside = np.argsort(np.repeat(slot, df) * len(order) + place[owner])
            blob = pack(
                np.array(ids, np.int64)[order], length[order], term[at], slot.astype(np.uint32), df[by_size].astype(np.uint32), place[owner[inside]].astype(np.uint32), count[inside].astype(np.uint32)
            )
            lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(x)) for x in (term[at].view(np.int64), df.astype(np.int64))]
            files, base = open_fs(folder)
            files.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(blob)
            return pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([int(length.sum())]), *lists, pa.array([name])], names=["n_docs", "total", "terms", "df", "name"])

        for part in slices(batches):
            ids += part.column(0).to_pylist()
            texts += part.column(1).cast(pa.binary()).to_pylist()
            size = sum(map(len, texts)) if size == 0 else size + sum(map(len, texts[-part.num_rows :]))
            if size >= shard_bytes or len(ids) >= SHARD_ROWS:
                yield emit()
                ids, texts, size = [], [], 0
        if ids:
            yield emit()

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, schema)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, n of each query's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column(0).to_numpy()
            term, owner, count = terms_of(part.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(term.view(np.int64)), pa.array(count)], names=["query_id", "term", "n"])

    found = queries.where("doc_id IS NOT NULL").mapInArrow(run, "query_id long, term long, n long")
    return found.groupBy("query_id", "term").agg(F.sum("n").alias("n"))


class Asked:
    """A chunk's queries: their ids, and the terms with their weights in order of queries; ``best`` has the best k so far."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query = np.repeat(np.arange(len(ids)), size)
        self.terms, self.number = np.unique(terms, return_inverse=True)
        self.weights = weights
        self.score, self.doc = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def offer(self, rows: np.ndarray, at: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Documents with their scores for the queries ``rows``; ``at`` is the place in rows."""
        place = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        score, doc = np.concatenate([self.score[rows].ravel(), np.round(score, 6)]), np.concatenate([self.doc[rows].ravel(), doc])
        order = np.lexsort((doc, -score, place))
        first = np.searchsorted(place[order], np.arange(len(rows)))
        keep = order[first[:, None] + np.arange(self.k)]
        self.score[rows], self.doc[rows] = score[keep], doc[keep]

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.doc[q, j]), pa.array(self.score[q, j])], names=["query_id", "doc_id", "score"])


def read_asked(dataset: ds.Dataset, k: int) -> Iterator[Asked]:
    """The queries of a chunk, in portions that hold a bounded number of terms."""
    held: list[tuple] = []
    rows = terms = 0
    for b in dataset.to_batches(batch_size=64):
        size = pc.list_value_length(b.column(1)).to_numpy()
        if held and (terms + int(size.sum()) > CHUNK_TERMS or rows + len(size) > 2 * CHUNK_ROWS):
            yield Asked(*map(np.concatenate, zip(*held, strict=True)), k)
            held, rows, terms = [], 0, 0
        held.append((b.column(0).to_numpy(), size, b.column(1).flatten().to_numpy().view(np.uint64), b.column(2).flatten().to_numpy()))
        rows, terms = rows + len(size), terms + int(size.sum())
    if held:
        yield Asked(*map(np.concatenate, zip(*held, strict=True)), k)


class Shard:
    """A shard's postings as impacts, ready to search."""

    def __init__(self, blob: bytes, mean_length: float):
        self.ids, length, self.terms, self.slot, df, docs, count = unpack(blob)
        self.n = len(self.ids)
        self.df = df.astype(np.int64)
        self.at = np.cumsum(self.df) - self.df
        norm = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        # impact and document of a posting in one number, as that halves the cost of fetching them from memory
        self.postings = np.empty(len(docs), np.complex128)
        self.postings.real = count * (K1 + 1) / (count + norm[docs])
        self.postings.imag = docs
        self.blocks = -(-self.n // BLOCK)
        self.wide = self.blocks * BLOCK
        most = min(LISTS, max(1, CELLS // max(1, self.wide)))
        self.often = min(most, int(np.count_nonzero(self.df >= max(2, FREQUENT * self.n))))
        size = self.df[: self.often]
        part = slice(0, int(size.sum()))
        self.frequent = np.zeros((self.often, self.wide))
        self.frequent[np.repeat(np.arange(self.often), size), docs[part]] = self.postings.real[part]
        self.block_max = self.frequent.reshape(self.often, self.blocks, BLOCK).max(2)
        self.opened = 0  # blocks, of all queries so far

    def search(self, asked: Asked) -> None:
        """Offer to each query the documents of this shard that may be among its best."""
        if not len(self.terms) or not len(asked.terms):
            return
        where = np.minimum(np.searchsorted(self.terms, asked.terms), len(self.terms) - 1)
        where = np.where(self.terms[where] == asked.terms, self.slot[where].astype(np.int64), -1)[asked.number]
        hit = np.flatnonzero((where >= 0) & (asked.weights > 0))
        q, t, w = asked.query[hit], where[hit], asked.weights[hit]
        often = t < self.often
        weight = np.zeros((len(asked.ids), self.often))
        weight[q[often], t[often]] = w[often]
        bound = weight @ self.block_max  # what the lists from the pivot on can add in a block
        q, t, w = q[~often], t[~often], w[~often]
        ends = np.searchsorted(q, np.arange(len(asked.ids) + 1)).tolist()
        first, size = self.at[t], self.df[t]
        order = np.argsort(bound.argmax(1), kind="stable")  # queries that open the same blocks side by side
        rows = max(1, min(BATCH, SCORES // self.wide))
        room = np.empty((min(rows, len(order)), self.wide))
        for a in range(0, len(order), rows):
            r = order[a : a + rows]
            score = room[: len(r)]
            for line, j in enumerate(r.tolist()):  # the lists before the pivot
                part = slice(ends[j], ends[j + 1])
                some = self.postings[spread(first[part], size[part])]
                score[line] = np.bincount(some.imag.astype(np.int64), some.real * np.repeat(w[part], size[part]), self.wide)
            self.open(asked, r, score, weight[r], bound[r])

    def open(self, asked: Asked, r: np.ndarray, score: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> None:
        """Add the frequent lists in blocks that can hold one of the best, and offer what reaches the threshold."""
        threshold = asked.score[r, -1]
        live = score.reshape(len(r), self.blocks, BLOCK).max(2) + bound >= threshold[:, None] - SLACK
        self.opened += int(live.sum())
        used = np.flatnonzero(weight.any(0))
        if len(used) < 0.7 * weight.shape[1]:
            weight = weight[:, used]
        else:
            used = slice(None)
        for x in range(0, self.blocks, RUN):
            part = slice(x * BLOCK, (x + RUN) * BLOCK)
            some = np.flatnonzero(live[:, x : x + RUN].any(1))
            if len(some) > 0.8 * len(r):
                score[:, part] += weight @ self.frequent[used, part]
            elif len(some):
                score[some, part] += weight[some] @ self.frequent[used, part]
        score, k = score[:, : self.n], asked.k
        fresh = np.isneginf(threshold)
        if fresh.any() and self.n > k:
            threshold[fresh] = np.partition(score[fresh], self.n - k, axis=1)[:, self.n - k]
        least = np.maximum(threshold - SLACK, np.nextafter(0, 1))
        for a in range(0, len(r), 32):  # many copies can tie, so few queries at once
            at, doc = np.nonzero(score[a : a + 32] >= least[a : a + 32, None])
            if len(at):
                asked.offer(r[a : a + 32], at, self.ids[doc], score[a + at, doc])


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each query by BM25."""
    spark = docs.sparkSession
    bound_arrow_batches(spark, 1000)
    folder = new_path(spark, "postings")
    shards = materialise(build_shards(id_text(docs, id_col, text_col), folder, shard_bytes), "shards")
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    frequency = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).withColumnRenamed("terms", "term")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = query_terms(id_text(queries, id_col, text_col)).join(frequency.hint("merge"), "term").select("query_id", F.struct("term", (F.col("n") * idf).alias("weight")).alias("t"))
    # ids with a term are counted first, so that chunks have CHUNK_ROWS of them on the average
    lists = materialise(asked.groupBy("query_id").agg(F.collect_list("t").alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "asked")
    chunks = max(1, -(-lists.count() // CHUNK_ROWS))
    path = new_path(spark, "queries")
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")
    lists.withColumn("chunk", chunk).repartition(chunks, "chunk").write.partitionBy("chunk").parquet(path)
    mean = total / n if n else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy_memory()
        for b in batches:
            for names, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, inner = open_fs(f"{path}/chunk={part}")
                if files.get_file_info(inner).type == fs.FileType.NotFound:  # no query has this number
                    continue
                for asked in read_asked(ds.dataset(inner, filesystem=files, format="parquet"), max(1, k)):
                    for name in names:
                        files, base = open_fs(folder)
                        with files.open_input_stream(f"{base}/{name}", compression=None) as held:
                            Shard(held.read(), mean).search(asked)
                    yield asked.found()
        tidy_memory()

    names = sorted(r.name for r in shards.select("name").collect())
    groups = -(-len(names) // max(1, min(TASK_SHARDS, len(names) * chunks // TASKS)))
    # from one partition, so that no task is dealt two rows and none goes without
    tasks = spark.createDataFrame([(names[g::groups],) for g in range(groups)], "names array<string>").coalesce(1).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = tasks.repartition(min(max(1, groups * chunks), 20_000)).mapInArrow(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 100 = 0"))
