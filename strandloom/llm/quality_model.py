"""Quality classifier: a label model over heuristic labellers, and hashed linear scorers trained on its posteriors.

Labellers vote good, bad or not at all on each of two targets, low quality and toxicity; they overlap, and where a
table of annotations is given the annotator is one of them. Expectation-maximisation estimates for each labeller
how it votes on good and on bad documents, and the prior, from the counts of vote patterns over all documents (a
few hundred rows, whatever the corpus). The annotator starts as some ``ANNOTATOR_VOTES`` votes of reliability 0.995,
which tie the classes to their meaning. The posterior of a document's pattern is its weak label, annotated or not.

A scorer is linear in hashed features: words, word beginnings, and bands of style measures, each present or not.
It is trained on posteriors of a bounded sample of about ``sample_rows`` documents of all vote patterns, half of
them annotated ones if there are so many. Features are counted where the documents are; those that go with the
posterior by chance are left out by a normal test, and the driver fits the weights of the rest (20,000 at most) by
logistic regression over the sample's rows, which hold nothing but such features. All documents are scored; one is
kept if each target's score is below its limit.

Defined cases: null, empty or blank texts have no style votes and score as their bias says, which keeps them; very
long texts are one row of a batch; rows with equal ids are rows, and equal rows are one of the sample; a null id is
scored like any other and is not sampled; without annotations, or with an empty table of them, the sample is drawn
from all documents; annotations that repeat an id count as their mean, those with a null id or null values not at
all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow_batches, discard, id_text, materialise, read_table, slices

#: Plain insults, fixed lists: names for people, what is said of them, and hostile verbs. No word is in two lists.
NAMES = frozenset(b"clown garbage idiot jerk loser losers moron scum scumbag trash vermin".split())
SLURS = frozenset(b"disgusting dumb filthy idiotic moronic pathetic stupid vile worthless".split())
HOSTILE = frozenset(b"despise hate hates loathe shut".split())
INSULTS = NAMES | SLURS
#: Frequent English words, a fixed list: the lists above say nothing of a text with fewer than one in fifty of them.
ENGLISH = frozenset(b"and in is of that the to".split())
TARGETS = ("low_quality", "toxic")
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = {"low_quality": ("symbols", "capitals", "repeats", "lines", "lengths", "annotator"), "toxic": ("names", "slurs", "hostile", "annotator")}
#: The annotator's reliability is given as if so many votes had been seen.
ANNOTATOR_VOTES = 2000
SYMBOLS = b"#*$%&|<>=~^{}[]\\@_"
#: Numbers for hashed words; the bands of style measures have their own numbers above them.
WORD_DIMENSIONS = 1 << 22
BANDS = (b"symbols", b"capitals", b"repeats", b"distinct", b"lines")
DIMENSIONS = WORD_DIMENSIONS + 10 * len(BANDS) + 16 + 3
SAMPLE_ROWS = 16_000
#: A document is rejected from these scores on. Toxicity shows in a few words, so one clear marker is enough.
LIMITS = (0.0, -2.0)
STRIP = b".,;:!?\"'()" + SYMBOLS


@dataclass
class Style:
    """Measures of one text, from its words."""

    words: list[bytes]
    symbols: float = 0.0
    capitals: float = 0.0
    repeats: float = 0.0
    distinct: float = 1.0
    lines: float = 0.0
    length: float = 0.0
    english: float = 0.0
    insults: list[bytes] = field(default_factory=list)
    bare: set[bytes] = field(default_factory=set)


def style(text: bytes) -> Style:
    words = text.split()
    s = Style(words)
    n = len(words)
    if not n:
        return s
    size = len(text)
    s.symbols = (size - len(text.translate(None, SYMBOLS))) / n
    lowered = text.lower()
    small = lowered.split()
    different = set(small)
    s.distinct = len(different) / n
    s.english = sum(map(ENGLISH.__contains__, small)) / n
    if lowered != text:
        some = [w for w in words if len(w) > 1 and w[:2].isupper()]
        s.capitals = len(some) / n
    s.repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    rows = [x for x in text.split(b"\n") if x.strip()]
    s.lines = 1 - len(set(rows)) / len(rows) if rows else 0.0
    s.length = sum(map(len, words)) / n
    s.bare = {w.strip(STRIP) for w in different}
    s.insults = [w for w in s.bare if w in INSULTS]
    return s


def vote(low: float, high: float, x: float) -> int:
    return GOOD if x <= low else BAD if x >= high else NONE


def votes(s: Style) -> list[int]:
    """Votes of all labellers but the annotator, for both targets in turn."""
    n = len(s.words)
    if not n:
        return [NONE] * 8
    enough = n >= 10
    quality = [
        vote(0.05, 0.3, s.symbols),
        vote(0.15, 0.5, s.capitals),
        vote(0.03, 0.25, s.repeats) if enough else NONE,
        vote(0.3, 0.5, s.lines),
        GOOD if 2 <= s.length <= 14 else BAD if s.length > 30 else NONE,
    ]
    quiet = GOOD if s.english >= 0.02 else NONE
    return [*quality, *(quiet if x.isdisjoint(s.bare) else BAD for x in (NAMES, SLURS)), NONE if HOSTILE.isdisjoint(s.bare) else BAD]


def style_bands(s: Style) -> list[int]:
    """One number for the band of each measure, for the text's size and for its insults."""
    measures = (s.symbols, s.capitals, s.repeats, s.distinct, s.lines)
    numbers = [WORD_DIMENSIONS + 10 * k + min(9, int(10 * x)) for k, x in enumerate(measures)]
    above = WORD_DIMENSIONS + 10 * len(BANDS)
    return [*numbers, above + min(15, len(s.words).bit_length()), above + 16 + min(2, len(s.insults))]


def word_features(w: bytes) -> list[int]:
    """Hashes of a word and of its beginnings of 4, 5 and 6 bytes."""
    names = [b"w" + w, *(b"p%d" % k + w[:k] for k in (4, 5, 6) if len(w) >= k)]
    return [zlib.crc32(x) % WORD_DIMENSIONS for x in names]


def features(s: Style, cache: dict[bytes, list[int]]) -> np.ndarray:
    out: set[int] = set()
    if len(cache) > 100_000:
        cache.clear()
    for w in s.bare:
        f = cache.get(w)
        if f is None:
            f = cache[w] = word_features(w)
        out.update(f)
    out.update(style_bands(s))
    return np.fromiter(out, np.int64, len(out))


class LabelModel:
    """Expectation-maximisation for one target over counts of vote patterns.

    A table holds P(vote | class) of each labeller when it votes. The last labeller is the annotator, whose start
    weighs ``ANNOTATOR_VOTES`` votes; the others' weighs 20.
    """

    def __init__(self, labellers: int, annotator: float = 0.995):
        self.prior_bad = 0.1
        self.table = np.repeat(np.array([[[0.7, 0.3], [0.1, 0.9]]]), labellers, 0)  # classes and votes: bad, good
        self.table[-1] = [[annotator, 1 - annotator], [1 - annotator, annotator]]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(bad) of each row of votes; no vote says nothing."""
        each = np.log(self.table)[np.arange(patterns.shape[1])[None], :, np.minimum(patterns, 1)]
        each[patterns == NONE] = 0.0
        logs = each.sum(1) + np.log([self.prior_bad, 1 - self.prior_bad])
        return 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -60, 60)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
        start = self.table.copy()
        for _ in range(rounds if counts.sum() else 0):
            bad = self.posterior(patterns)
            weight = np.stack([bad * counts, (1 - bad) * counts])
            self.prior_bad = float(np.clip(weight[0].sum() / counts.sum(), 1e-3, 0.5))
            last = patterns.shape[1] - 1
            for k in range(last + 1):
                for v in (BAD, GOOD):
                    # the start acts as some votes, so that a labeller without votes keeps its meaning
                    self.table[k, :, v] = weight[:, patterns[:, k] == v].sum(1) + (ANNOTATOR_VOTES if k == last else 20) * start[k, :, v]
                self.table[k] /= self.table[k].sum(1, keepdims=True)
        return self


def fit_scorer(rows: list[list[int]], bad: np.ndarray, picked: list[int], epochs: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the picked features and the bias, by logistic regression; a row holds its features' numbers."""
    number = {f: k for k, f in enumerate(picked)}
    mine = [[number[f] for f in r if f in number] for r in rows]
    flat, own = np.array([k for r in mine for k in r], np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in mine])
    rate = float(np.clip(bad.mean() if len(bad) else 0.0, 1e-4, 1 - 1e-4))
    # full-batch steps with a size of their own for each weight (Adagrad)
    w, bias = np.zeros(len(picked)), float(np.log(rate / (1 - rate)))
    squares, square = np.full(len(picked), 1e-2), 1e-2
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-np.clip(bias + np.bincount(own, w[flat], len(rows)), -60, 60))) - bad
        slope, tilt = np.bincount(flat, error[own], len(picked)) + 1e-3 * w, float(error.sum())
        squares, square = squares + slope * slope, square + tilt * tilt
        w, bias = w - slope / np.sqrt(squares), bias - tilt / np.sqrt(square)
    return w, bias


def annotated(labels: DataFrame | None) -> DataFrame | None:
    """doc_id and the annotator's votes, one row per id."""
    if labels is None:
        return None
    by_id = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    say = lambda x, bad: F.when(x.isNull(), NONE).when(bad, BAD).otherwise(GOOD)
    return by_id.select("doc_id", say(F.col("quality"), F.col("quality") < 0.5).alias("a0"), say(F.col("toxic"), F.col("toxic") >= 0.5).alias("a1"))


def vote_table(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [bytes(votes(style(t))) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["doc_id", "votes"])

    return texts.mapInArrow(run, "doc_id long, votes binary")


def pattern_of(raw: bytes, a: tuple[int, int]) -> tuple[list[int], list[int]]:
    return [*raw[:5], a[0]], [*raw[5:], a[1]]


def sample_of(joined: DataFrame, counts: dict[bool, int], sample_rows: int) -> DataFrame:
    """About ``sample_rows`` documents of ``joined``, half of them annotated if there are so many; counts: rows by annotated or not."""
    noted = min(counts[True], max(sample_rows // 2, sample_rows - counts[False]))
    shares = {True: noted / max(1, counts[True]), False: min(1.0, (sample_rows - noted) / max(1, counts[False]))}
    share = F.when((F.col("a0") != NONE) | (F.col("a1") != NONE), int(shares[True] * (1 << 30))).otherwise(int(shares[False] * (1 << 30)))
    return joined.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < share).select("doc_id", "votes", "a0", "a1").dropDuplicates(["doc_id", "votes"])


def weak_labels(models: list[LabelModel], votes: list[bytes], a0: list[int], a1: list[int]) -> list[np.ndarray]:
    """P(bad) of each document, for each target; NaN where no labeller votes, as such documents teach nothing."""
    both = [pattern_of(v, a) for v, *a in zip(votes, a0, a1, strict=True)]
    out = []
    for k, m in enumerate(models):
        patterns = np.array([b[k] for b in both], np.int64).reshape(len(both), len(m.table))
        out.append(np.where((patterns == NONE).all(1), np.nan, m.posterior(patterns)))
    return out


def feature_counts(rows: DataFrame, models: list[LabelModel]) -> DataFrame:
    """feature, in how many labelled rows it is (n0, n1) and the sums of their posteriors (b0, b1); feature -1 is in every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[int]] = {}
        for part in slices(batches, most=1 << 20):  # the arrays below are many times the text
            found = [features(style(t), cache) for t in part.column(1).cast(pa.binary()).to_pylist()]
            own = np.repeat(np.arange(len(found)), [len(f) + 1 for f in found])
            flat, at = np.unique(np.concatenate([np.append(f, -1) for f in found]), return_inverse=True)
            bad = weak_labels(models, *(part.column(k).to_pylist() for k in (2, 3, 4)))
            sums = [np.bincount(at, y[own], len(flat)) for x in bad for y in ((~np.isnan(x)).astype(float), np.nan_to_num(x))]
            yield pa.RecordBatch.from_arrays([pa.array(flat), *map(pa.array, sums)], names=["feature", "n0", "b0", "n1", "b1"])

    counted = rows.select("doc_id", "text", "votes", "a0", "a1").mapInArrow(run, "feature long, n0 double, b0 double, n1 double, b1 double")
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n0", "b0", "n1", "b1")])


def picked_features(counts: DataFrame, target: int, least_z: float = 5.0, most: int = 20_000) -> list[int]:
    """Features that speak clearly for bad; few do, and the bias speaks for good."""
    total = counts.where("feature = -1").first()
    if total is None or not total[f"n{target}"]:
        return []
    rate = float(np.clip(total[f"b{target}"] / total[f"n{target}"], 1e-4, 1 - 1e-4))
    seen, bad = F.col(f"n{target}"), F.col(f"b{target}")
    z = (bad - rate * seen) / F.sqrt(seen * (rate * (1 - rate)))
    clear = counts.where((F.col("feature") >= 0) & (seen >= 4)).where((z > least_z) & ((seen - bad) / seen < 0.3))
    return sorted(r["feature"] for r in clear.orderBy(z.desc(), "feature").limit(most).collect())


def sample_features(rows: DataFrame, picked: set[int]) -> DataFrame:
    """doc_id, votes, a0, a1 and the picked features of each document of the sample, equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[int]] = {}
        for part in slices(batches):
            found = [sorted(picked.intersection(features(style(t), cache).tolist())) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "votes", "a0", "a1", "found"])

    return rows.select("doc_id", "text", "votes", "a0", "a1").mapInArrow(run, "doc_id long, votes binary, a0 int, a1 int, found array<long>").dropDuplicates(["doc_id", "votes"])


def train(texts: DataFrame, labels: DataFrame | None, sample_rows: int) -> tuple[list[LabelModel], list[tuple[np.ndarray, np.ndarray, float]]]:
    table = materialise(vote_table(texts), "votes")
    notes = annotated(labels)
    if notes is None:
        notes = table.sparkSession.createDataFrame([], "doc_id long, a0 int, a1 int")
    joined = table.join(notes, "doc_id", "left").withColumns({"a0": F.coalesce("a0", F.lit(NONE)), "a1": F.coalesce("a1", F.lit(NONE))})
    groups = joined.groupBy("votes", "a0", "a1").agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("m")).collect()
    patterns = [pattern_of(bytes(r["votes"]), (r["a0"], r["a1"])) for r in groups]
    counts = np.array([r["n"] for r in groups], float)
    models = [LabelModel(len(LABELLERS[t])).fit(np.array([p[k] for p in patterns], np.int64).reshape(-1, len(LABELLERS[t])), counts) for k, t in enumerate(TARGETS)]

    there = {x: sum(r["m"] for r in groups if ((r["a0"], r["a1"]) != (NONE, NONE)) == x) for x in (True, False)}
    sample = materialise(sample_of(joined, there, sample_rows), "sample")
    rows = texts.join(F.broadcast(sample), "doc_id")  # about sample_rows rows of 40 bytes
    counted = materialise(feature_counts(rows, models), "features")
    picked = [picked_features(counted, k) for k in range(len(TARGETS))]
    known = sample_features(rows, set().union(*picked)).toArrow()  # about sample_rows rows of few numbers
    bad = weak_labels(models, *(known.column(c).to_pylist() for c in ("votes", "a0", "a1")))
    scorers, found = [], known.column("found").to_pylist()
    for k in range(len(TARGETS)):
        taught = np.flatnonzero(~np.isnan(bad[k]))
        w, bias = fit_scorer([found[i] for i in taught.tolist()], bad[k][taught], picked[k]) if len(taught) else (np.zeros(len(picked[k])), -4.0)
        scorers.append((np.array(picked[k], np.int64), w, bias))
    discard(table, sample, counted)
    return models, scorers


def scorer_of(scorers: list[tuple[np.ndarray, np.ndarray, float]]):
    """A function from texts to both targets' scores."""
    tables = [dict(zip(f.tolist(), w.tolist(), strict=True)) for f, w, _ in scorers]
    biases = [b for _, _, b in scorers]

    def score(texts: list[bytes], known: dict[bytes, tuple]) -> tuple[np.ndarray, np.ndarray]:
        scores: list[list[float]] = [[], []]
        for text in texts:
            s = style(text)
            if len(known) > 200_000:
                known.clear()
            hits: set[int] = set()
            for w in s.bare:
                f = known.get(w)
                if f is None:
                    f = known[w] = tuple(x for x in word_features(w) if x in tables[0] or x in tables[1])
                if f:
                    hits.update(f)
            hits.update(style_bands(s))
            for k in range(2):
                scores[k].append(biases[k] + sum(tables[k].get(x, 0.0) for x in hits))
        return np.array(scores[0]), np.array(scores[1])

    return score


def classify_quality(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, low_quality and toxic (log-odds scores), kept, for every row."""
    bound_arrow_batches(docs.sparkSession)
    texts = id_text(docs, id_col, text_col)
    score = scorer_of(train(texts, labels, sample_rows)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for part in slices(batches):
            low, toxic = score(part.column(1).cast(pa.binary()).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(low), pa.array(toxic), pa.array((low < LIMITS[0]) & (toxic < LIMITS[1]))], names=["doc_id", "low_quality", "toxic", "kept"])

    return texts.mapInArrow(run, "doc_id long, low_quality double, toxic double, kept boolean")


def keep_documents(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; the text goes through Python once."""
    bound_arrow_batches(docs.sparkSession)
    score = scorer_of(train(id_text(docs, id_col, text_col), labels, sample_rows)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for part in slices(batches, column=0):
            low, toxic = score([t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()], known)
            yield part.filter(pa.array((low < LIMITS[0]) & (toxic < LIMITS[1])))

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("row"))
    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
