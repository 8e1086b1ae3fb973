"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list whose operands are always made by earlier merges ("proper") can be applied in rank order. Whether
the boundary before a symbol survives depends on a bounded stretch to its right. Let rule r join u and v. Given
that u stands to the left of the boundary, r removes it only if v stands to the right, that is if no earlier
rule crosses v's right end. Such a rule t < r has as left operand the token that ends v at that moment, a token
of v's right spine, and is decided by its own right operand in turn. So

    F(r) = |v| + max(F(t) : t < r, left operand of t on the right spine of v while t is applied)

symbols suffice, and the lookahead is the maximum of F. A token is emitted once that many symbols follow its
end, or once its word has ended within the window; what follows is a fresh input, since no merge crosses a boundary
that lasts. Memory is a window of a constant number of symbols however long a word is. Every pre-token goes through
this transducer: the windows of many words are its lanes and are merged together with array operations, the lowest
rank first and the leftmost among equals.

Decoding joins vocabulary strings through a byte machine: bytes go in token by token, text comes out as soon as
its UTF-8 is complete.

Defined cases: null or empty text gives no ids and an empty text; special strings in a text become their ids as
in the library's default; every row gets a result, repeated ids included; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow_batches, id_text, read_table, slices

#: Entries of a worker's cache; beyond that it becomes the older half, which is dropped in turn, so memory stays constant.
CACHE_ENTRIES = 300_000
NO_RANK = np.int32(2**31 - 1)
END = "</w>"
#: White space of the tokenizer's pattern syntax; Python's str.split() also splits at U+001C to U+001F.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list with its lookahead and a hash table from pairs to ranks."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = END):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = [(a.removesuffix(suffix) if suffix else a) + b for a, b in pairs]
        self.made = np.array([vocab[x] for x in joined], np.int64)
        self.names = {i: x for x, i in vocab.items()}
        self.sizes = np.ones(max(self.names) + 1, np.int64)
        for i in self.names:
            self.sizes[i] = self.length(i)
        self._table()
        self.lookahead = self._lookahead()
        self.window = 2 * (self.lookahead + self.longest)

    def length(self, token: int) -> int:
        name = self.names[token]
        return len(name.removesuffix(self.suffix) if self.suffix else name)

    def _lookahead(self) -> int:
        made_at: dict[int, int] = {}
        for r, m in enumerate(self.made.tolist()):
            made_at.setdefault(m, r)
        decided: dict[int, tuple[list[int], list[int]]] = {}
        most = 1
        for r, (u, v) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            if made_at.get(u, -1) >= r or made_at.get(v, -1) >= r:
                raise ValueError(f"merge {r} uses a token that a later merge makes; the lookahead holds for proper lists only")
            token, until, beyond = v, r, 0
            while True:
                ranks, best = decided.get(token, ((), ()))
                k = bisect_left(ranks, until)
                if k:
                    beyond = max(beyond, best[k - 1])
                if token not in made_at:
                    break
                until = made_at[token]
                token = int(self.right[until])
            here = self.length(v) + beyond
            ranks, best = decided.setdefault(u, ([], []))
            ranks.append(r)
            best.append(max(here, best[-1] if best else 0))
            most = max(most, here)
        self.longest = max([1, *(self.length(t) for t in made_at)])
        return most

    def _table(self) -> None:
        self.bits = max(8, int(len(self.left) * 16).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        for r, key in enumerate(((self.left << 32) | self.right).tolist()):
            slot = self._slot(np.array([key]))[0]
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) % size
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_many(self, symbols: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of many short words; lane tells the word and ascends. Tokens and their words, in order."""
        done_tokens, done_lanes = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK, np.int32)
            inner = np.flatnonzero(lane[1:] == lane[:-1])
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
            starts = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
            least = np.minimum.reduceat(rank, starts)
            of = np.repeat(least, np.diff(np.append(starts, len(symbols))))
            ended = of == NO_RANK
            done_tokens.append(symbols[ended])
            done_lanes.append(lane[ended])
            at = np.flatnonzero((rank == of) & ~ended)
            if not len(at):
                break
            if len(at) > 1:  # of touching pairs, as in three equal symbols, the left ones merge
                new_run = np.append(True, np.diff(at) != 1)
                if not new_run.all():
                    run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            left = ~ended
            left[at + 1] = False
            symbols, lane = symbols[left], lane[left]
        tokens, owner = np.concatenate(done_tokens or [symbols]), np.concatenate(done_lanes or [lane])
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def step(self, symbols: np.ndarray, sizes: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One window of several words: the tokens that are stable, their words, and how many symbols each word is done with.

        ``ended`` tells whether a word ends in its window; else a token is stable if ``lookahead`` symbols follow it.
        """
        tokens, lane = self.merge_many(symbols, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
        length = self.sizes[tokens]
        total = np.cumsum(length)
        end = total - (total - length)[np.searchsorted(lane, np.arange(len(sizes)))][lane]
        stable = ended[lane] | (end + self.lookahead <= sizes[lane])
        return tokens[stable], lane[stable], np.bincount(lane[stable], length[stable], len(sizes)).astype(np.int64)

    def transduce(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words, window by window, and their words; no word is empty."""
        ends = np.cumsum(sizes)
        at, live = ends - sizes, np.arange(len(sizes))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            stop = np.minimum(at[live] + self.window, ends[live])
            n = stop - at[live]
            held = symbols[np.repeat(at[live] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            ended = stop == ends[live]
            tokens, lane, done = self.step(held, n, ended)
            found.append((tokens, live[lane]))
            at[live] += done
            live = live[~ended]
        tokens, owner = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (symbols, symbols)
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one word as they become stable; at most a window of symbols is held."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) == self.window:
                tokens, _, done = self.step(np.array(held, np.int64), np.array([len(held)]), np.array([False]))
                yield from tokens.tolist()
                held = held[int(done[0]) :]
        if held:
            yield from self.step(np.array(held, np.int64), np.array([len(held)]), np.array([True]))[0].tolist()


#: What the encoder implements, as tokenizer files state it; the pattern of the split is a parameter.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def supported(spec: dict) -> None:
    """Refuse a tokenizer file that asks for other steps than those done here."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    alike = len(steps) == 2 and all(steps[0].get(k) == v for k, v in SPLIT.items()) and all(steps[1].get(k) == v for k, v in BYTE_LEVEL.items())
    plain = not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") != NORMALIZER or not alike or not plain:
        raise ValueError("this tokenizer's normaliser, pre-tokenizer or model is not supported")


class Encoder:
    """Encodes whole texts as the tokenizer file says: specials, normaliser, pre-tokens, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        symbols, vocab, suffix = byte_symbols(), model["vocab"], self.merges.suffix
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.names = {**self.merges.names, **{i: t for t, i in self.special.items()}}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """The stretches between white space of the normalised text."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        text = text.lower()
        return [x for x in _SPACE.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def _fill(self, chunks: list[str]) -> None:
        """Ids of chunks that the cache lacks: all their pre-tokens go through the transducer together."""
        find = self.pattern.findall
        words, counts = [], []
        for c in chunks:
            found = [c] if c.isalpha() else find(c)
            words += found
            counts.append(len(found))
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        codes = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.inner[codes], np.cumsum(sizes) - 1
        symbols[ends] = self.last[codes[ends]]
        tokens, owner = self.merges.transduce(symbols, sizes)
        cuts = (np.searchsorted(owner, np.append(0, np.cumsum(counts))) * 4).tolist()
        data = tokens.astype("<u4").tobytes()
        self.chunks.update(zip(chunks, [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _plain(self, texts: list[str]) -> list[bytes]:
        pieces = [self.parts(t) for t in texts]
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks, self.older = {}, self.chunks
        known, older = self.chunks, self.older
        missing = set().union(*pieces).difference(known)
        known.update([(x, older[x]) for x in missing if x in older])
        if missing := list(missing.difference(known)):
            self._fill(missing)
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out = []
        with_special = [k for k, t in enumerate(texts) if self.special_at is not None and self.special_at.search(t)] if any("<|" in t for t in texts) else []
        out = self._plain(["" if k in with_special else t for k, t in enumerate(texts)] if with_special else texts)
        for k in with_special:
            parts = self.special_at.split(texts[k])
            plain = self._plain(parts[::2])
            out[k] = b"".join(x for i, p in enumerate(plain) for x in ([self.special[parts[2 * i - 1]].to_bytes(4, "little"), p] if i else [p]))
        return out


class Decoder:
    """Bytes of tokens in, text out: a token's bytes may end inside a character, which then waits.

    With ``joined`` the vocabulary strings are joined by a space, which is what the library does for a file
    without a decoder; without it byte symbols become bytes again and word ends become spaces.
    """

    def __init__(self, names: dict[int, str], suffix: str = END, joined: bool = True):
        back = {s: b for b, s in enumerate(byte_symbols())}
        self.joined = joined
        if joined:
            self.bytes = {i: x.encode() for i, x in names.items()}
        else:
            self.bytes = {}
            for i, x in names.items():
                body = x.removesuffix(suffix) if suffix else x
                data = bytes(back[c] for c in body) if all(c in back for c in body) else body.encode()
                self.bytes[i] = data + b" " * (body != x)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine, gap = codecs.getincrementaldecoder("utf-8")("replace"), b""
        for i in ids:
            if text := machine.decode(gap + self.bytes[i]):
                yield text
            gap = b" " if self.joined else b""
        if text := machine.decode(b"", True):
            yield text

    def decode(self, ids: bytes, at_once: int = 65536) -> bytes:
        """The text in UTF-8. Blocks of tokens pass through the byte machine in turn."""
        numbers = np.frombuffer(ids, "<u4")
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        out, gap = [], b" " if self.joined else b""
        for k in range(0, len(numbers), at_once):
            block = gap.join(map(self.bytes.__getitem__, numbers[k : k + at_once].tolist()))
            out.append(machine.decode((gap if k else b"") + block))
        out.append(machine.decode(b"", True))
        return "".join(out).encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str, joined: bool) -> Decoder:
    e = encoder(path)
    return Decoder(e.names, e.merges.suffix, joined)


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", joined: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string) of every row."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = encoder(tokenizer), decoder(tokenizer, joined)
        for part in slices(batches, most=2 << 20):
            ids = e.encode_many(part.column(1).to_pylist())
            decoded = pa.array([d.decode(x) for x in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), decoded], names=["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
