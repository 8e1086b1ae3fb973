"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens. The packer sees nothing but how many pieces there are of
each length, a table of at most ``capacity`` rows however large the corpus is. On it a branch and bound runs: it
takes the largest length left, enumerates the undominated fillings of the space beside it, best fit first, applies a
filling to as many bins as the counts allow or to one, and prunes a branch when its bins so far and the lower bound
of the rest, or its wasted space, cannot beat the incumbent. The first incumbent is best-fit decreasing. The search
ends at the lower bound, when nothing is left to try (the incumbent is then the optimum), or after ``nodes`` fillings;
``Completion.gap`` tells how far above the bound its result is. The result is a list of bin patterns with
multiplicities. Each piece then finds its bin from its rank among the pieces of its length, which two-level counts
give without bringing a length's pieces to one task.

Defined cases: null text is an empty document, which is one token long (the separator); repeated and null ids and
texts are documents of their own; a document longer than the capacity is cut, its first piece taking the remainder;
an empty table gives no rows; other columns of the documents are ignored; of pieces, columns named sequence_id or
offset are replaced, and a length that is null or not from 1 to the capacity raises a ValueError.
"""

from __future__ import annotations

import bisect
import json
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import CACHE_ENTRIES, byte_symbols
from .common import bound_arrow_batches, id_text, materialise, read_table, slices, with_rest

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: The pre-token pattern of byte-level vocabularies of this family.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevelEncoder:
    """Ids as the tokenizers library gives them, with a bounded cache of the stretches between spaces.

    A single space that does not stand between two white-space characters always starts a pre-token, so a text
    may be cut there. Texts with other white space around a space, or with special strings, go to the library
    whole. Stretches that the cache lacks are encoded by rank, which equals the merge list when token ids ascend
    with merges; that is checked on loading, and else the library encodes them too.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        back = {s: b for b, s in enumerate(byte_symbols())}
        self.by_rank = None
        if all(a < b for a, b in zip(made, made[1:], strict=False)):
            ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unsafe = regex.compile(r"[\s\x1c-\x1f] [\s\x1c-\x1f]")
        self.inner: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stretch(self, text: str) -> bytes:
        return np.array(self.by_rank.encode_ordinary(text), "<u4").tobytes() if self.by_rank else self._whole(text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.unsafe.search(t) or any(s in t for s in self.special) else t.split(" ") for t in texts]
        if len(self.inner) > CACHE_ENTRIES:
            self.inner, self.older = {}, self.inner
        known, older = self.inner, self.older
        missing = set().union(*(c[1:] for c in cut if c)).difference(known)
        known.update([(x, older[x]) for x in missing if x in older])
        known.update([(x, self._stretch(" " + x)) for x in missing.difference(known)])
        return [
            self._whole(t) if c is None else self._stretch(c[0]) + b"".join(map(known.__getitem__, c[1:]))
            for t, c in zip(texts, cut, strict=True)
        ]


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; the first takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids, separator included, with the ids as little-endian unsigned 32-bit integers."""
    bound_arrow_batches(docs.sparkSession)
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer).encode_many
        for part in slices(batches, most=2 << 20):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for column, x in zip(rows, (doc, k, start, length, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the bound that pairs large with middle lengths; sizes ascend."""
    if not len(sizes):
        return 0
    volume = sizes * counts
    best = -(-int(volume.sum()) // capacity)
    above = np.searchsorted(sizes, capacity // 2, side="right")
    n_half, v_half = int(counts[above:].sum()), int(volume[above:].sum())
    small = sizes[:above]
    if n_half:
        n_cum, v_cum = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(volume))
        at = np.searchsorted(sizes, capacity - small, side="right")
        n_mid, v_mid = n_cum[at] - n_cum[above], v_cum[at] - v_cum[above]
        v_low = v_cum[above] - v_cum[np.arange(above)]
        extra = np.maximum(0, -(-(v_low - (n_mid * capacity - v_mid)) // capacity))
        best = max(best, n_half, n_half + int(extra.max(initial=0)))
    return best


Patterns = list[tuple[tuple[int, ...], int]]


class Completion:
    """Bin completion over a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = 4000):
        if any(not 0 < s <= capacity for s in counts):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        self.capacity, self.nodes, self.tried, self.gap = capacity, nodes, 0, 0
        self.counts = {s: c for s, c in counts.items() if c > 0}
        self.total = sum(s * c for s, c in self.counts.items())

    def bound(self, left: dict[int, int]) -> int:
        sizes = np.array(sorted(s for s, c in left.items() if c), np.int64)
        return lower_bound(sizes, np.array([left[s] for s in sizes.tolist()], np.int64), self.capacity)

    def fill(self, sizes: list[int], left: dict[int, int], room: int) -> list[int]:
        """Best fit: again and again the largest length left that fits."""
        chosen, used = [], Counter()
        k = bisect.bisect_right(sizes, room)
        while k and room:
            s = sizes[k - 1]
            n = min(left[s] - used[s], room // s)
            if n > 0:
                chosen += [s] * n
                used[s] += n
                room -= n * s
            k = min(k - 1, bisect.bisect_right(sizes, room))
        return chosen

    def fillings(self, left: dict[int, int], room: int) -> Iterator[list[int]]:
        """All undominated fillings of the room, the first by best fit.

        ``left`` is changed while a filling is made, and is as the caller left it whenever one is handed over.
        """
        sizes = array("i", sorted(s for s, c in left.items() if c and s <= room))
        chosen: list[int] = []
        below = len(sizes)
        while True:
            while below and room:  # add the largest lengths that fit
                s = sizes[below - 1]
                if s <= room and left[s]:
                    chosen.append(s)
                    left[s] -= 1
                    room -= s
                below = min(below if s <= room and left[s] else below - 1, bisect.bisect_right(sizes, room))
            self.tried += 1
            if not self.dominated(chosen, sizes, left, room):
                for s in chosen:
                    left[s] += 1
                yield list(chosen)
                for s in chosen:
                    left[s] -= 1
            if not chosen or self.tried >= self.nodes:
                for s in chosen:
                    left[s] += 1
                return
            s = chosen.pop()
            left[s] += 1
            room += s
            below = bisect.bisect_left(sizes, s)

    def dominated(self, chosen: list[int], sizes: Sequence[int], free: dict[int, int], slack: int) -> bool:
        """Whether a free length could be added, replace one item, or replace two by one at least as large, within the room."""
        there = lambda low, high: any(free[s] for s in sizes[bisect.bisect_left(sizes, low) : bisect.bisect_right(sizes, high)])
        used = Counter(chosen)
        if slack and (there(1, slack) or any(there(s + 1, s + slack) for s in used)):
            return True
        pairs = [a + b for a in used for b in used if a < b or a == b and used[a] > 1]
        return any(there(x, x + slack) for x in pairs)

    def apply(self, left: dict[int, int], pattern: list[int]) -> int:
        need = Counter(pattern)
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
        return times

    def best_fit(self) -> Patterns:
        left, out = dict(self.counts), []
        sizes = sorted(left)
        while sizes:
            top = sizes[-1]
            left[top] -= 1
            pattern = [top, *self.fill(sizes, left, self.capacity - top)]
            left[top] += 1
            out.append((tuple(pattern), self.apply(left, pattern)))
            for s in set(pattern):
                if not left[s]:
                    del sizes[bisect.bisect_left(sizes, s)]
        return out

    def branches(self, left: dict[int, int]) -> Iterator[tuple[list[int], int]]:
        """What can be done with the largest length left: a filling beside it, for as many bins as possible or for one."""
        top = max(s for s, c in left.items() if c)
        left[top] -= 1
        for f in self.fillings(left, self.capacity - top):
            left[top] += 1
            pattern = [top, *f]
            most = min(left[s] // n for s, n in Counter(pattern).items())
            for times in dict.fromkeys((most, 1)):
                yield pattern, times
            left[top] -= 1
        left[top] += 1

    def solve(self) -> Patterns:
        best = self.best_fit()
        bins = sum(n for _, n in best)
        least = self.bound(self.counts)
        used = waste = 0
        # one table of lengths left, changed in place; a frame holds what is still to be tried at its depth
        left, path = dict(self.counts), []
        frames: list[Iterator[tuple[list[int], int]]] = [self.branches(left)] if left else []
        while frames and bins > least and self.tried < self.nodes:
            step = next(frames[-1], None)
            if step is None:
                frames.pop()
                if path:
                    self.use(left, path[-1], -1)
                    pattern, times = path.pop()
                    used, waste = used - times, waste - times * (self.capacity - sum(pattern))
                continue
            pattern, times = step
            self.use(left, (tuple(pattern), times), 1)
            path.append((tuple(pattern), times))
            used, waste = used + times, waste + times * (self.capacity - sum(pattern))
            open_ = any(left.values())
            if not open_ and used < bins:
                best, bins = list(path), used
            promising = open_ and used + self.bound(left) < bins and waste <= (bins - 1) * self.capacity - self.total
            frames.append(self.branches(left) if promising else iter(()))
        self.gap = bins - least
        return best

    @staticmethod
    def use(left: dict[int, int], step: tuple[tuple[int, ...], int], sign: int) -> None:
        pattern, times = step
        for s, n in Counter(pattern).items():
            left[s] -= sign * n * times


def placements(patterns: Patterns) -> dict[str, np.ndarray]:
    """Per length and pattern: the ranks it takes, and where they go. Sorted by length and first rank."""
    taken: Counter = Counter()
    rows, base = [], 0
    for pattern, times in patterns:
        at = 0
        for s, n in Counter(pattern).items():
            rows.append((s, taken[s], n, base, at))
            taken[s] += n * times
            at += s * n
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "each": a[:, 2], "base": a[:, 3], "offset": a[:, 4]}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", nodes: int = 4000) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to ``capacity`` tokens; other columns come along.

    The pieces are written once, so that ranks stay the same if an executor is lost.
    """
    with_rest(pieces, length_col)
    row = F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row")
    rows = pieces.select(row, F.col(f"`{length_col}`").cast("long").alias("length"))
    kind = rows.schema["row"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            lengths = np.clip(b.column(1).fill_null(0).to_numpy(zero_copy_only=False), 0, capacity)  # wrong ones are refused below
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            nth = np.empty(len(lengths), np.int64)
            nth[order] = np.arange(len(lengths)) - np.searchsorted(ordered, ordered) + seen[ordered]
            np.add.at(seen, lengths, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(nth)], names=["row", "length", "part", "nth"])

    ranked = materialise(rows.mapInArrow(rank, f"row {kind}, length long, part int, nth long"), "pieces")
    counts = ranked.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    total = {r["length"]: int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 3).collect()}
    if any(s is None or not 0 < s <= capacity for s in total):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    where = placements(Completion(total, capacity, nodes).solve())
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = ranked.join(before, ["part", "length"]).select("row", "length", (F.col("before") + F.col("nth")).alias("rank"))
    key = where["length"] << 44 | where["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            k = np.searchsorted(key, lengths << 44 | ranks, side="right") - 1
            bin_, slot = np.divmod(ranks - where["rank"][k], where["each"][k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(where["base"][k] + bin_), pa.array(where["offset"][k] + slot * lengths)], names=["row", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"row {kind}, sequence_id long, offset long")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (binary), from packed pieces that carry their ids."""
    with_rest(packed, "sequence_id", "offset", "ids")
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokenize_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(digests)
