"""From links to components, positions and the pseudogenome."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ranking import global_rank, running_sum
from strandloom.operators.store import checkpointed, discard

CHUNK = 4096
#: Links that one task may take: about 500 MB.
TASK_ROWS = 4_000_000


def _arrays(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of a table that a task may hold."""
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns)] if held else []


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=names)


def _contracted(edges: DataFrame, merged: Callable[[str, str], Column], turn: int) -> tuple[DataFrame, DataFrame]:
    """Paths and cycles of ``edges`` (u, v, x) with about a third of their nodes skipped, and those nodes as (v, u, x).

    A node is skipped if its hash is below its neighbours', so that no two neighbours are; ``merged`` joins the x of two edges.
    """
    role = lambda node, other, name: edges.select(F.col(node).alias("node"), F.struct(F.col(other).alias("at"), "x").alias(name))
    both = role("v", "u", "into").unionByName(role("u", "v", "out"), allowMissingColumns=True)
    nodes = both.groupBy("node").agg(F.max("into").alias("into"), F.max("out").alias("out"))
    h = lambda c: F.xxhash64(c, F.lit(turn))
    low = F.col("into").isNotNull() & F.col("out").isNotNull() & (h("node") < h("into.at")) & (h("node") < h("out.at"))
    known = checkpointed(nodes.withColumn("skipped", F.coalesce(low, F.lit(False))), "nodes", "skipped")
    gone = known.where("skipped")
    stay = known.where("NOT skipped AND out IS NOT NULL").select(F.col("node").alias("u"), F.col("out.at").alias("v"), F.col("out.x").alias("x"))
    over = gone.select(F.col("into.at").alias("u"), F.col("out.at").alias("v"), merged("into.x", "out.x").alias("x"))
    left = checkpointed(stay.join(gone.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v", "x").unionByName(over), "edges")
    return left, gone.select(F.col("node").alias("v"), F.col("into.at").alias("u"), F.col("into.x").alias("x"))


def cycle_cuts(succ: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The least weight of each cycle; ``succ`` has each node's next, or their number at a path's end."""
    n = len(succ)
    hop, least, reach = np.append(succ, n), np.append(weight, np.iinfo(np.int64).max), 1
    while left := np.count_nonzero(hop[:n] < n):
        least, hop = np.minimum(least, least[hop]), hop[hop]
        if reach >= left:  # a path's nodes that had not met its end were at most so many, and now have
            break
        reach *= 2
    return np.unique(least[:n][hop[:n] < n])


def cut_cycles(links: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Cut each cycle at its link of least (overlap, read_id).

    Links are contracted, by a third each round, until at most ``task_rows`` are left; one task finds their cycles.
    """
    edges = links.select(F.col("read_id").alias("u"), F.col("next_id").alias("v"), F.struct("overlap", "read_id").alias("x"))
    turn, made = 0, []
    while edges.count() > task_rows:
        turn += 1
        edges, gone = _contracted(edges, lambda a, b: F.least(a, b), turn)
        made.append(edges)
        discard(*made[-2:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := _arrays(batches)):
            return
        u, v, overlap, ident = held
        order = np.argsort(u)
        at = np.minimum(np.searchsorted(u, v, sorter=order), len(u) - 1)
        succ = np.where(u[order[at]] == v, order[at], len(u))
        by = np.lexsort((ident, overlap))
        weight = np.empty(len(u), np.int64)
        weight[by] = np.arange(len(u))
        yield from _batches(["read_id"], ident[by[cycle_cuts(succ, weight)]])

    cuts = checkpointed(edges.select("u", "v", "x.overlap", "x.read_id").repartition(1).mapInArrow(run, "read_id long"), "cuts")
    return links.join(cuts, "read_id", "left_anti")


def path_ranks(u: np.ndarray, v: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head of the path, and sums of n and d from there, of each v of edges u, v; without cycles."""
    order = np.argsort(v)
    at = np.minimum(np.searchsorted(v, u, sorter=order), len(v) - 1)
    none = len(v)
    hop = np.append(np.where(v[order[at]] == u, order[at], none), none)
    n, d, root = np.append(n, 0), np.append(d, 0), np.arange(none + 1)
    while (hop < none).any():
        root = np.where(hop < none, root[hop], root)
        n, d, hop = n + n[hop], d + d[hop], hop[hop]
    return u[root[:none]], n[:none], d[:none]


def list_ranks(reads: DataFrame, links: DataFrame, length: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """read_id, head, rank and start of each read in its component.

    Paths are contracted, by a third each round, until at most ``task_rows`` links are left; one task ranks their
    reads, and the skipped ones follow from the reads before them, round by round.
    """
    step = F.struct(F.lit(1).cast("long").alias("n"), (F.lit(length) - F.col("overlap")).cast("long").alias("d"))
    edges = links.select(F.col("read_id").alias("u"), F.col("next_id").alias("v"), step.alias("x"))
    turn, skipped = 0, []
    while edges.count() > task_rows:
        turn += 1
        edges, gone = _contracted(edges, lambda a, b: F.struct(*[(F.col(f"{a}.{c}") + F.col(f"{b}.{c}")).alias(c) for c in "nd"]), turn)
        skipped.append(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := _arrays(batches):
            yield from _batches(["read_id", "head", "rank", "start"], held[1], *path_ranks(*held))

    known = checkpointed(edges.select("u", "v", "x.n", "x.d").repartition(1).mapInArrow(run, "read_id long, head long, rank long, start long"), "ranks")
    for gone in reversed(skipped):
        before = known.select(F.col("read_id").alias("u"), "head", "rank", "start")
        new = gone.join(before, "u", "left").select(F.col("v").alias("read_id"), F.coalesce("head", "u").alias("head"), (F.coalesce("rank", F.lit(0)) + F.col("x.n")).alias("rank"), (F.coalesce("start", F.lit(0)) + F.col("x.d")).alias("start"))
        known = known.unionByName(checkpointed(new, "ranks"))
    zero = F.lit(0).cast("long")
    return reads.select("read_id").join(known, "read_id", "left").select("read_id", F.coalesce("head", "read_id").alias("head"), F.coalesce("rank", zero).alias("rank"), F.coalesce("start", zero).alias("start"))


def layout(reads: DataFrame, links: DataFrame, length: int) -> DataFrame:
    """comp_id, comp_rank, read_id, off, pos: components by ascending head, reads in link order."""
    ranks = checkpointed(list_ranks(reads, links, length), "ranks")
    sizes = ranks.groupBy("head").agg((F.max("start") + length).alias("size"))
    comps = global_rank(sizes, "head", [], "comp_id")
    ends = running_sum(comps, "comp_id", F.col("size"), "end")
    before = links.select(F.col("next_id").alias("read_id"), (F.lit(length) - F.col("overlap")).alias("gap"))
    rows = ranks.join(ends.select("head", "comp_id", (F.col("end") - F.col("size")).alias("base")), "head").join(before, "read_id", "left")
    return rows.select("comp_id", F.col("rank").cast("long").alias("comp_rank"), "read_id", F.coalesce("gap", F.lit(length)).cast("int").alias("off"), (F.col("base") + F.col("start")).alias("pos"))


def pg_chunks(placed: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """chunk, start, seq of the pseudogenome; chunks overlap by length-1 so that each read lies in one.

    ``placed`` has pos, off and seq: a read adds its last ``off`` bases (all of them where a component begins).
    """
    new = F.least("off", F.lit(length))
    own = placed.where(new > 0).select((F.col("pos") + length - new).alias("at"), F.substr("seq", F.lit(length + 1) - new, new).alias("s"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("at") - (length - 1)) / chunk)), F.floor((F.col("at") + F.length("s") - 1) / chunk)
    spread = own.select("at", "s", F.explode(F.sequence(first, last)).alias("chunk"))
    begin, end = F.col("chunk") * chunk, F.col("chunk") * chunk + chunk + length - 1
    cut_from, cut_to = F.greatest("at", begin), F.least(F.col("at") + F.length("s"), end)
    pieces = spread.where(cut_from < cut_to).select("chunk", F.struct(cut_from.alias("at"), F.substr("s", (cut_from - F.col("at") + 1).cast("int"), (cut_to - cut_from).cast("int")).alias("s")).alias("p"))
    joined = pieces.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))
    return joined.select(F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * chunk).cast("long").alias("start"), "seq")


def slice_reads(rows: DataFrame, chunks: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """Adds ``slice``, the ``length`` bases at ``pos``."""
    r = rows.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long"))
    return r.join(chunks, "chunk").withColumn("slice", F.substr("seq", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(length))).drop("chunk", "start", "seq")
