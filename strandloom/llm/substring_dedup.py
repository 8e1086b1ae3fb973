"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that an earlier document holds too.

The index is a logarithmic family of suffix arrays. A new batch gets an array of its suffixes cut at ``length``
bytes (deeper order decides nothing), is merge-scanned against each existing level for matches of that length,
and becomes a level; levels of equal size merge, so a suffix is merged a logarithmic number of times.

To run it on a cluster, windows of ``length`` bytes are dealt by their minimizer, the least hash of their
k-grams: equal windows have equal minimizers, and the run of windows with one minimizer is one stretch of text.
Three steps keep the volume small:

1. Copies of whole documents are found by SHA-256; the later ones are covered entirely.
2. Of the other documents only hashes of each stretch are shuffled: 64 bits of its minimizer and 128 of its own. A
   stretch that an earlier document has too is covered; all 192 bits decide. Tasks combine equal stretches first, so
   that a passage that very many documents hold is sent once per task, and say themselves which of the others are
   covered. Stretches with a minimizer of their own are done: no earlier window can equal theirs.
3. Stretches that share a minimizer but not the whole stretch are compared as bytes: each different one is sent
   from its first document and goes through the suffix-array family, batch by batch in order of documents. Where that
   document has it more than once, its other places come along as numbers and get what the first one gets.

A minimizer with very many contexts would make one shard large. Frequent ones (``HOT_ROWS`` stretches or more, by a
count over about ``SAMPLE_BYTES`` of text) are dealt window by window, by the hash of the window: equal windows meet,
different contexts spread. What the sample misses is only dealt less evenly; results do not depend on it.

Defined cases: null text is empty and has no bytes; a document shorter than ``length`` loses nothing; a very long
text is hashed in pieces; rows that share an id do not remove each other's bytes; a null id removes nothing and
loses nothing; an empty table gives no rows; other columns are ignored. Positions are bytes of UTF-8, the end
exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow_batches, discard, materialise, read_table, slices, tidy_memory, with_rest

GRAM = 16
SHARD_BYTES = 48 << 20
SHARD_WINDOWS = 1 << 20
BATCH_WINDOWS = 1 << 18
#: Stretches that make a minimizer frequent, and the bytes of text that are counted for it.
HOT_ROWS, SAMPLE_BYTES = 200_000, 64 << 20
NO_KEYS = np.zeros(0, np.uint64)
#: Bytes of text that are hashed at once: some 110 bytes of arrays a byte, and positions in it take 24 bits.
PIECE = 512 << 10


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return scramble(scramble(x) + np.uint64(0x632BE59BD9B4E019))


class Hashes:
    """Hashes of all stretches of a given length, by doubling."""

    def __init__(self, text: np.ndarray):
        self.n, self.by = len(text), {1: byte_codes()[text]}

    def power(self, k: int) -> np.ndarray:
        if k not in self.by:
            half = self.power(k // 2)
            self.by[k] = scramble(half[: self.n - k + 1] * np.uint64(0xD6E8FEB86659FD93) + half[k // 2 :])
        return self.by[k]

    def of(self, length: int) -> np.ndarray:
        out, at = None, 0
        for bit in range(length.bit_length() - 1, -1, -1):
            if length >> bit & 1:
                part = self.power(1 << bit)[at : at + self.n - length + 1]
                out = part if out is None else out * np.uint64(0xA0761D6478BD642F) + part
                at += 1 << bit
        return out


def stretches(texts: list[bytes], length: int, gram: int, hot: np.ndarray = NO_KEYS) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text number, first window, windows, minimizer's hash, stretch's two hashes.

    Windows of minimizers in ``hot`` (ascending) are runs of their own, with the window's hash in the key.
    """
    out: list[tuple[np.ndarray, ...]] = []
    held = 0

    def flush(pieces: list[tuple[int, int, bytes]]) -> None:
        text = np.frombuffer(b"".join(x for _, _, x in pieces), np.uint8)
        if len(text) < length:
            return
        sizes = np.array([len(x) for _, _, x in pieces], np.int64)
        ends = np.cumsum(sizes)
        h = Hashes(text)
        grams, windows = h.of(gram), h.of(length)
        w = length - gram + 1
        key = (scramble(grams) >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        least, span = key, 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(key) - w + 1], least[w - span : w - span + len(key) - w + 1])
        owner = np.repeat(np.arange(len(pieces)), sizes)[: len(windows)]
        at = np.flatnonzero(ends[owner] - np.arange(len(windows)) >= length)
        if not len(at):
            return
        low, owner = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64), owner[at]
        first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])))
        count = np.diff(np.append(first, len(at)))
        start, low, owner = at[first], scramble(grams[low[first]] + np.uint64(1)), owner[first]
        if len(hot):
            n = np.where(hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low, count, 1)
            single = np.repeat(n > 1, n)
            start = np.repeat(start, n) + np.where(single, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), 0)
            low, owner, count = np.repeat(low, n), np.repeat(owner, n), np.where(single, 1, np.repeat(count, n))
            alone = single | (hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low)
            low = np.where(alone, scramble(low * np.uint64(0x8CB92BA72F3D8DD7) + windows[start]), low)
        last = start + count - 1
        whole = scramble(windows[start] * np.uint64(0xE7037ED1A0B428DB) + windows[last]) + count.astype(np.uint64)
        # the second hash puts the same bytes together from other parts
        half = 1 << ((length - 1).bit_length() - 1)
        parts, again = h.power(half), np.zeros(len(start), np.uint64)
        for at_ in (start, start + length - half, last, last + length - half):
            again = scramble(again * np.uint64(0xD1342543DE82EF95) + parts[at_])
        base, doc = np.array([b for _, b, _ in pieces], np.int64), np.array([d for d, _, _ in pieces], np.int64)
        out.append((doc[owner], start - (ends - sizes)[owner] + base[owner], count, low, whole, again))

    pending: list[tuple[int, int, bytes]] = []
    for d, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, max(1, len(text) - length + 1), PIECE):  # pieces of a very long text overlap, windows do not
            piece = text[at : at + PIECE + length - 1]
            if held + len(piece) > PIECE + length - 1 and pending:
                flush(pending)
                pending, held = [], 0
            pending.append((d, at, piece))
            held += len(piece)
    if pending:
        flush(pending)
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, NO_KEYS, NO_KEYS, NO_KEYS
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    kinds = "".join(f"{a.dtype.str:>4}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + kinds + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    at, kinds, out = 8 + 8 * n + 4 * n, data[8 + 8 * n : 8 + 12 * n].decode(), []
    for k, size in enumerate(sizes.tolist()):
        kind = np.dtype(kinds[4 * k : 4 * k + 4].strip())
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def by_document(doc: np.ndarray, tag: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    order = np.lexsort((tag, doc))
    doc, tag, columns = doc[order], tag[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(first_of_runs(doc, tag)), len(doc)).tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(doc[i]), int(tag[i]), [c[i:j] for c in columns]


#: What shards tell, by bucket of documents: a row for a shard and a bucket, not for a shard and a document.
TOLD = "bucket int, covered binary, asked binary"
TOLD_TYPES = [pa.int32(), pa.binary(), pa.binary()]
FOUND = "doc_id long, tag long, covered binary, asked binary"
FOUND_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def pack_documents(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, *columns: np.ndarray) -> bytes:
    """A blob of rows, each document named once."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = first_of_runs(doc, tag)
    at = np.flatnonzero(new)
    wide = len(start) and int(start.max()) >> 31
    return pack(doc[at], tag[at], (np.cumsum(new) - 1).astype(np.uint32), start.astype(np.int64 if wide else np.uint32), *(c[order] for c in columns))


def by_bucket(buckets: int, doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    bucket = (scramble(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(first_of_runs(bucket[order])), len(order)).tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        k = order[i:j]
        yield int(bucket[k[0]]), pack_documents(doc[k], *(c[k] for c in columns))


def regroup(table: pa.Table) -> pa.Table:
    """One row per document of a bucket: its covered stretches and those to compare as bytes, of all shards."""
    rows: list[tuple] = []
    if covered := read_blobs(table.column("covered")):
        rows += [(d, t, pack(s, c), None) for d, t, (s, c) in by_document(*covered)]
    if asked := read_blobs(table.column("asked")):
        rows += [(d, t, None, pack(s, c, low)) for d, t, (s, c, low) in by_document(*asked)]
    return pa.Table.from_batches([batch_of(rows, FOUND_TYPES, ["doc_id", "tag", "covered", "asked"])])


def batch_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)


def hot_minimizers(docs: DataFrame, total: int, length: int, gram: int, hot_rows: int) -> np.ndarray:
    """Minimizers of ``hot_rows`` stretches or more by a count over a sample, ascending: at most one per 30 of its stretches."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    least = max(30 if share < 1 else 2, int(hot_rows * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=0):
            low, n = np.unique(stretches(part.column(0).cast(pa.binary()).to_pylist(), length, gram)[3], return_counts=True)
            often = n > 1  # what is frequent in the sample is so in some batch
            yield pa.RecordBatch.from_arrays([pa.array(low[often].view(np.int64)), pa.array(n[often])], names=["low", "n"])

    sample = docs.where(F.pmod(F.xxhash64("tag", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = sample.mapInArrow(run, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("low")
    return np.sort(np.array([r["low"] for r in found.collect()], np.int64).view(np.uint64))


def send_stretches(docs: DataFrame, shards: int, length: int, gram: int, hot: np.ndarray = NO_KEYS) -> DataFrame:
    """shard, entries (blob) and known (blob): what a task could not decide, and what it could."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            doc, tag, start, count, low, whole, again = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, again, whole, low))
            doc, tag, start, count, low, whole, again = (x[order] for x in (doc, tag, start, count, low, whole, again))
            new = first_of_runs(low, whole, again)
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
            settled = doc > least  # an earlier document of this task has the same stretch
            # what is settled needs no other stretch and is dealt by document, however frequent its minimizer
            shard = (np.where(settled, scramble(doc.view(np.uint64)), low) % np.uint64(shards)).astype(np.int64)
            rows = []
            for which, mask in ((0, ~settled), (1, settled)):
                at = np.flatnonzero(mask)
                at = at[np.argsort(shard[at], kind="stable")]
                cuts = np.append(np.flatnonzero(first_of_runs(shard[at])), len(at)).tolist()
                for i, j in zip(cuts, cuts[1:], strict=False):
                    k = at[i:j]
                    more = [low[k], whole[k], again[k]] if which == 0 else []
                    blob = pack_documents(doc[k], tag[k], start[k], count[k].astype(np.uint8), *more)
                    rows.append((int(shard[k[0]]), blob if which == 0 else None, blob if which else None))
            return batch_of(rows, [pa.int32(), pa.binary(), pa.binary()], ["shard", "entries", "known"])

        for part in slices(batches, column=2):
            doc, tag = (part.column(k).to_numpy() for k in (0, 1))
            texts = part.column(2).cast(pa.binary()).to_pylist()
            d, start, count, low, whole, again = stretches(texts, length, gram, hot)
            if len(d):
                held.append([doc[d], tag[d], start, count, low, whole, again])
            size += sum(map(len, texts))
            if size >= 16 << 20 and held:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return docs.mapInArrow(run, "shard int, entries binary, known binary")


def read_blobs(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """doc, tag, start, count and further columns of all blobs."""
    parts = []
    for x in column:
        if x.is_valid:
            doc, tag, which, start, *rest = unpack(x.as_py())
            parts.append([doc[which], tag[which], start.astype(np.int64), *rest])
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []


def settle_shard(buckets: int):
    """What the stretches of one shard tell: which are covered, and which are to be compared as bytes."""

    def run(table: pa.Table) -> pa.Table:
        tidy_memory()
        rows: list[tuple] = []
        if known := read_blobs(table.column("known")):
            rows += [(b, blob, None) for b, blob in by_bucket(buckets, *known)]
        if entries := read_blobs(table.column("entries")):
            doc, _, _, _, low, whole, again = entries
            order = np.lexsort((doc, again, whole, low))
            doc, tag, start, count, low, whole, again = (x[order] for x in entries)
            new_low = first_of_runs(low)
            new = new_low | first_of_runs(whole, again)
            covered = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]  # all places in the first document are compared
            rows += [(b, blob, None) for b, blob in by_bucket(buckets, doc[covered], tag[covered], start[covered], count[covered])]
            kinds = np.bincount((np.cumsum(new_low) - 1)[new])
            ask = ~covered & (kinds[np.cumsum(new_low) - 1] > 1)
            rows += [(b, None, blob) for b, blob in by_bucket(buckets, doc[ask], tag[ask], start[ask], count[ask], low[ask])]
        return pa.Table.from_batches([batch_of(rows, TOLD_TYPES, ["bucket", "covered", "asked"])])

    return run


class SuffixArray:
    """Different suffixes of a text in order, cut at one length: where each begins, and the first document that has it."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int):
        self.text, self.starts, self.docs, self.length = text, starts, docs, length
        windows = np.lib.stride_tricks.sliding_window_view(text, length)
        # strings of fixed length drop zero bytes at their end, so each gets a closing byte
        held = np.ones((len(starts), length + 1), np.uint8)
        held[:, :length] = windows[starts]
        self.keys = held.view(f"S{length + 1}")[:, 0]
        self.heads = first_bytes(text, starts, length)

    @classmethod
    def of(cls, text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
        """Order suffixes by their bytes, eight at a time from the last; each start has ``length`` bytes. Also each start's place."""
        cuts = [*range(0, max(1, length - 7), 8), *([length - 8] if length > 8 and length % 8 else [])]
        blocks = [first_bytes(text, starts + c, length - c) for c in cuts]
        order = np.lexsort((docs, *blocks[::-1]))
        new = first_of_runs(*(x[order] for x in blocks))
        place = np.empty(len(starts), np.int64)
        place[order] = np.cumsum(new) - 1
        return cls(text, starts[order][new], docs[order][new], length), place

    def places(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """A merge scan: where each suffix of the other array comes in this one, and whether it is there.

        The first eight bytes tell the place of most; the others are looked for among all bytes.
        """
        at = np.searchsorted(self.heads, other.heads)
        near = np.flatnonzero(self.heads[np.minimum(at, len(self.heads) - 1)] == other.heads)
        at[near] = np.searchsorted(self.keys, other.keys[near])
        there = np.zeros(len(at), bool)
        there[near] = self.keys[np.minimum(at[near], len(self.keys) - 1)] == other.keys[near]
        return at, there

    def joined(self, other: SuffixArray) -> SuffixArray:
        """Both arrays merged; a suffix of both keeps its first document."""
        at, there = self.places(other)
        docs = self.docs.copy()
        docs[at[there]] = np.minimum(docs[at[there]], other.docs[there])
        fresh = ~there
        starts = np.insert(self.starts, at[fresh], other.starts[fresh] + len(self.text))
        return SuffixArray(np.append(self.text, other.text), starts, np.insert(docs, at[fresh], other.docs[fresh]), self.length)


def first_bytes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The first eight bytes from each start, or ``length`` if that is less, as numbers in the order of the bytes."""
    padded = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8)
    numbers = np.ascontiguousarray(padded[starts]).view(">u8")[:, 0].astype(np.uint64)
    return numbers >> np.uint64(8 * max(0, 8 - length))


class SuffixLevels:
    """A family of suffix arrays whose sizes grow geometrically."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def scan(self, mine: SuffixArray) -> np.ndarray:
        """The first document that has each suffix of the batch, over all levels and the batch, by merge scans."""
        least = mine.docs.copy()
        for level in self.levels:
            at, there = level.places(mine)
            least[there] = np.minimum(least[there], level.docs[at[there]])
        return least

    def add(self, array_: SuffixArray) -> None:
        while self.levels and len(self.levels[-1].starts) <= 2 * len(array_.starts):
            array_ = self.levels.pop().joined(array_)
        self.levels.append(array_)

    def match(self, text: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether an earlier document has each suffix; the batch joins the family."""
        if not len(starts):
            return np.zeros(0, bool)
        mine, place = SuffixArray.of(text, starts, docs, self.length)
        least = self.scan(mine)
        self.add(mine)
        return least[place] < docs


def fetch_bytes(found: DataFrame, docs: DataFrame, shards: int, length: int) -> DataFrame:
    """shard, blob of the stretches that are to be compared as bytes: each once a row, with its other places there."""
    wanted = found.where("asked IS NOT NULL").select("doc_id", "tag", F.array("asked").alias("asked"))
    joined = docs.join(wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=2):
            texts = part.column(2).cast(pa.binary()).to_pylist()
            columns: list[list[np.ndarray]] = []
            pieces: list[bytes] = []
            others: list[list[np.ndarray]] = []
            for d, t, text, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist(), strict=True):
                start, count, low = (np.concatenate(x) for x in zip(*map(unpack, asked), strict=True))
                number: dict[bytes, int] = {}
                cut = (text[s : s + c + length - 1] for s, c in zip(start.tolist(), count.tolist(), strict=True))
                which = np.fromiter((number.setdefault(x, len(number)) for x in cut), np.int64, len(start))
                first = np.unique(which, return_index=True)[1]
                more = np.delete(np.arange(len(which)), first)
                others.append([which[more] + len(pieces), start[more].astype(np.int64)])
                columns.append([np.full(len(first), d, np.int64), np.full(len(first), t, np.int64), start[first].astype(np.int64), count[first].astype(np.int64), low[first]])
                pieces += number
            if not columns:
                continue
            doc, tag, start, count, low = (np.concatenate(x) for x in zip(*columns, strict=True))
            shard = (scramble(low) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.append(np.flatnonzero(first_of_runs(shard[order])), len(order)).tolist()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            which, also = (np.concatenate(x) for x in zip(*others, strict=True))
            by = np.argsort(place[which], kind="stable")
            which, also = place[which[by]], also[by]
            rows = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                k, (a, b) = order[i:j], np.searchsorted(which, [i, j])
                text = np.frombuffer(b"".join([pieces[x] for x in k.tolist()]), np.uint8)
                rows.append((int(shard[k[0]]), pack(doc[k], tag[k], start[k], count[k], low[k], text, which[a:b] - i, also[a:b])))
            yield batch_of(rows, [pa.int32(), pa.binary()], ["shard", "blob"])

    return joined.mapInArrow(run, "shard int, blob binary")


def compare_shard(length: int, buckets: int):
    """Passes one shard's stretches through a suffix-array family, in order of documents."""

    def run(table: pa.Table) -> pa.Table:
        tidy_memory()
        parts = [unpack(x.as_py()) for x in table.column("blob")]
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        doc, tag, start, count, low, text, owner, also = (np.concatenate(x) for x in zip(*parts, strict=True))
        owner = owner + np.repeat(base[:-1], [len(p[6]) for p in parts])  # ascending
        del parts
        sizes = count + length - 1
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((low, doc))
        family, hits, at = SuffixLevels(length), [], 0
        total = np.cumsum(count[order])
        while at < len(order):
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + BATCH_WINDOWS, side="right")))
            k = order[at:end]
            n, size = count[k], sizes[k]
            which = np.repeat(np.arange(len(k)), n)
            shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            batch = text[np.repeat(begin[k] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            hit = np.flatnonzero(family.match(batch, (np.cumsum(size) - size)[which] + shift, doc[k][which]))
            w, s = which[hit], shift[hit]
            if len(hit):  # neighbouring windows make one run
                new = np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1))
                f = np.flatnonzero(new)
                runs = np.diff(np.append(f, len(hit)))
                hits.append([k[w[f]], s[f], runs.astype(np.uint8)])
            at = end
        rows: list[tuple] = []
        if hits:
            k, s, runs = (np.concatenate(x) for x in zip(*hits, strict=True))
            left, right = (np.searchsorted(owner, k, side=x) for x in ("left", "right"))
            n = right - left
            of = np.repeat(np.arange(len(k)), n)
            places = also[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(len(of))]
            of, places = np.append(np.arange(len(k)), of), np.append(start[k], places)
            rows = [(b, blob, None) for b, blob in by_bucket(buckets, doc[k[of]], tag[k[of]], places + s[of], runs[of])]
        return pa.Table.from_batches([batch_of(rows, TOLD_TYPES, ["bucket", "covered", "asked"])])

    return run


def spans_of(covered: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal covered runs of bytes."""
    parts = [unpack(x) for x in covered]
    start = np.concatenate([p[0].astype(np.int64) for p in parts])
    end = start + np.concatenate([p[1].astype(np.int64) for p in parts]) + length - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), end[last].tolist(), strict=True))


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, "
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = GRAM, carry: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, removed spans and the bytes that are left, for every row; with ``carry`` what is left as text
    instead, in ``left`` (a character that a cut divides goes), and the other columns, in ``row``, with ``no_text``."""
    if not 8 <= gram < length or length - gram + length > 255:
        raise ValueError("need 8 <= gram < length and 2 * length - gram <= 255")
    spark = docs.sparkSession
    bound_arrow_batches(spark, 1000)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row = [F.struct(F.col(f"`{text_col}`").isNull().alias("no_text"), *others).alias("row")] if carry else []
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    with_rest(docs, id_col, text_col)
    all_rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"), *row)
    texts = all_rows.select("doc_id", "tag", "text")
    long = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    digests = materialise(long.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = materialise(digests.join(firsts, "digest").where("doc_id > first").select("doc_id", "tag").distinct(), "copies")
    total = digests.agg(F.sum("n")).first()[0] or 0

    rest = long.join(copies, ["doc_id", "tag"], "left_anti").select("doc_id", "tag", "text")
    buckets = max(1, -(-total // SHARD_BYTES))  # as many of documents as of stretches
    hot = hot_minimizers(long, total, length, gram, hot_rows)
    told = send_stretches(rest, buckets, length, gram, hot).groupBy("shard").applyInArrow(settle_shard(buckets), TOLD)
    found = materialise(told.groupBy("bucket").applyInArrow(regroup, FOUND), "stretches")
    asked = found.where("asked IS NOT NULL").agg(F.sum(F.octet_length("asked"))).first()[0] or 0
    shards = max(1, -(-asked // 10 * (length - gram) // 2 // SHARD_WINDOWS))
    told = fetch_bytes(found, long, shards, length).groupBy("shard").applyInArrow(compare_shard(length, buckets), TOLD)
    compared = materialise(told.groupBy("bucket").applyInArrow(regroup, FOUND), "compared")
    discard(digests)

    covered = found.unionByName(compared).where("covered IS NOT NULL").groupBy("doc_id", "tag").agg(F.collect_list("covered").alias("covered"))
    covered = covered.select("doc_id", "tag", "covered", F.lit(False).alias("whole"))
    whole = copies.select("doc_id", "tag", F.array().cast("array<binary>").alias("covered"), F.lit(True).alias("whole"))
    joined = all_rows.join(covered.unionByName(whole), ["doc_id", "tag"], "left").select("doc_id", "text", "covered", "whole", *["row"] * carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for d, text, cover, all_ in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                spans = [(0, len(text))] if all_ else spans_of(cover, length) if cover else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                rows.append((d, len(text), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, text[at:]])))
            if carry:
                out = batch_of([(d, n, spans, left.decode("utf-8", "ignore")) for d, n, spans, left in rows], [pa.int64(), pa.int64(), _SPANS, pa.string()], ["doc_id", "n_bytes", "spans", "left"])
                out = out.append_column("row", part.column(4))
            else:
                out = batch_of(rows, [pa.int64(), pa.int64(), _SPANS, pa.binary()], ["doc_id", "n_bytes", "spans", "kept"])
            yield out

    more = f"left string, row {joined.schema['row'].dataType.simpleString()}" if carry else "kept binary"
    return joined.mapInArrow(run, RESULT + more)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )
