"""Secret scan with a battery of randomness tests, in DataFrame functions only.

Base patterns come first. Then runs of token characters outside base spans are candidates. Their encoding is
inferred from the characters present, each symbol gets its value in that encoding's alphabet, and three tests
ask whether a uniformly random string would look like it: chi-squared uniformity over 8 cells of the alphabet,
Wald-Wolfowitz runs about the alphabet's middle, and lag-one serial correlation. Each gives an approximately
normal z; the combined p-value of a random string is close to uniform on (0, 1], that of words piles up at 0.

Rejecting words is therefore a selection problem, and it is controlled by encoding and length: a short string
has little power, so that words pass more often. Candidates of one encoding and length class share a histogram
of p-values. The density above ``storey`` estimates how many are random (Storey's estimator turned round: the
random ones are uniform); what exceeds it above a threshold is false. The lowest threshold at which the false
share is at most ``fdr`` is taken, and none if no threshold reaches it. The table of thresholds has at most
4 encodings x 8 length classes x 50 cells, so it is small whatever the corpus.

Defined cases: null or empty text gives zero counts, the digest of the empty string and empty spans; rows with
equal ids stay rows; an empty table gives no rows; other columns are ignored. Positions are code points, the end
exclusive. Method spans have kind "random" and never overlap base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, read_table

#: The base patterns, fixed values. The group and the least length of it that a match needs.
PATTERNS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Cheap tests that a text must pass before its pattern is run over it.
HINTS = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}"}
KINDS = [*PATTERNS, "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets in order of value, fixed values.
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base64": UPPER + LOWER + DIGITS + "+/"}
CELLS = 8


def found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end) of the kept matches: pieces between matches and the matches themselves add up."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    items = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("n"), F.length(x["value"]).alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    folded = F.aggregate(
        items,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(x["value"] >= least, F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return folded["spans"]


def spans_of(kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.col("text").rlike(HINTS[kind]), found(F.col("text"), pattern, group, least)).otherwise(none)


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def encoding(token: Column) -> Column:
    body = F.rtrim(token, F.lit("="))
    return (
        F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$") & body.rlike("[0-9]") & body.rlike("[A-Fa-f]"), "hex")
        .when(body.rlike("^[A-Z2-7]+$") & body.rlike("[2-7]"), "base32")
        .when(body.rlike("^[a-z0-9]+$") & body.rlike("[0-9]"), "base36")
        .when(body.rlike("[A-Z]") & body.rlike("[a-z]") & body.rlike("[0-9]"), "base64")
    )


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a logistic approximation, exact to about 2e-4 and monotone."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z))))


def battery(token: Column, kind: Column) -> Column:
    """Combined p-value under uniform randomness of the token in its encoding."""
    body = F.rtrim(F.when(kind == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/")), F.lit("="))
    alphabet = F.create_map(*[x for k, a in ALPHABETS.items() for x in (F.lit(k), F.lit(a))])[kind]
    size = F.length(alphabet)
    values = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: ((F.instr(alphabet, c) - 1) + 0.5) / size)
    n = F.size(values).cast("double")
    per_cell = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.size(F.filter(values, lambda v: F.floor(v * CELLS) == k)).cast("double"))
    # share of the alphabet in each cell, since 36 or 64 symbols need not divide evenly
    shares = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda s: F.floor((s + 0.5) / size * CELLS) == k)) / size)
    chi = F.aggregate(F.zip_with(per_cell, shares, lambda o, p: (o - n * p) * (o - n * p) / (n * p)), F.lit(0.0), lambda a, x: a + x)
    df = CELLS - 1.0
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    pairs = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    changes = F.size(F.filter(pairs, lambda x: (x["a"] < 0.5) != (x["b"] < 0.5))).cast("double")
    z_runs = F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + (x["a"] - 0.5) * (x["b"] - 0.5))
    z_serial = F.abs(serial) / (F.sqrt(n - 1) / 12)
    p = lambda z, sides: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), sides * normal_tail(z)))
    # Fisher's sum of three, with the closed form of its tail for six degrees of freedom
    x = -(F.log(p(z_chi, 1.0)) + F.log(p(z_runs, 2.0)) + F.log(p(z_serial, 2.0)))
    return F.exp(-x) * (1 + x + x * x / 2)


def length_class(n: Column) -> Column:
    return F.least(F.lit(7), F.floor((F.log2(n.cast("double")) - 4) * 2)).cast("int")


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, one array of spans per base kind."""
    d = id_text(docs, id_col, text_col)
    return d.select("doc_id", "text", *[spans_of(k).alias(k) for k in PATTERNS])


def candidates(text: Column, base: Column) -> Column:
    """Candidate tokens that no base span touches: (start, end, token, encoding, length class)."""
    found_at = found(text, CANDIDATE, 0, 1)
    clear = F.filter(found_at, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    named = F.transform(clear, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.substr(text, c["start"] + 1, c["end"] - c["start"]).alias("token")))
    typed = F.transform(named, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"), encoding(c["token"]).alias("encoding"), length_class(c["end"] - c["start"]).alias("size")))
    return F.filter(typed, lambda c: c["encoding"].isNotNull())


def tokens_of() -> Column:
    """The candidates of a row that has its text and base spans, with their p-values."""
    spans = F.concat(*[F.col(k) for k in PATTERNS])
    none = F.array().cast("array<struct<start:int,end:int,token:string,encoding:string,size:int>>")
    tokens = F.when(F.col("text").rlike("[A-Za-z0-9+/_-]{20}"), candidates(F.col("text"), spans)).otherwise(none)
    return F.transform(tokens, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), c["size"].alias("size"), battery(c["token"], c["encoding"]).alias("p")))


def scored(base: DataFrame) -> DataFrame:
    """Base spans and candidates, without the text."""
    return base.select("doc_id", *PATTERNS, tokens_of().alias("tokens"))


def thresholds(tokens: DataFrame, fdr: float, storey: float, least: int, cells: int = 50) -> DataFrame:
    """encoding, size, threshold: the lowest p at which the estimated false share is at most ``fdr``."""
    from pyspark.sql import Window

    cell = F.least(F.lit(cells - 1), F.floor(F.col("p") * cells)).cast("int")
    counts = tokens.groupBy("encoding", "size", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("encoding", "size")
    above = group.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    random = F.sum(F.when(F.col("cell") >= int(storey * cells), F.col("n")).otherwise(0)).over(group) / (1 - int(storey * cells) / cells)
    table = counts.withColumns({"random": random, "accepted": F.sum("n").over(above), "low": F.col("cell") / cells})
    false = F.greatest(F.lit(0.0), F.col("accepted") - F.col("random") * (1 - F.col("low"))) / F.col("accepted")
    good = table.where((false <= fdr) & (F.col("random") >= least))
    return good.groupBy("encoding", "size").agg(F.min("low").alias("threshold"))


def limit_map(tokens: DataFrame, fdr: float, storey: float, least: int) -> Column:
    """The thresholds as a literal map; there are at most 4 encodings x 8 length classes."""
    limits = thresholds(tokens, fdr, storey, least).collect()
    known = [x for r in limits for x in (F.lit(f"{r['encoding']}/{r['size']}"), F.lit(float(r["threshold"])))]
    return F.create_map(*known) if known else F.create_map().cast("map<string,double>")


def picked(tokens: Column, limits: Column) -> Column:
    """The spans of candidates at or above their class's threshold."""
    class_of = lambda c: F.concat_ws("/", c["encoding"], c["size"].cast("string"))
    good = F.filter(tokens, lambda c: c["p"] >= F.coalesce(F.try_element_at(limits, class_of(c)), F.lit(2.0)))
    return F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))


def token_rows(done: DataFrame) -> DataFrame:
    return done.select(F.explode("tokens").alias("c")).select("c.encoding", "c.size", "c.p")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, storey: float = 0.5, least: int = 2) -> DataFrame:
    """doc_id and arrays of (start, end) for each base kind and for ``random``, one row per document.

    ``fdr`` bounds the false share of the spans that the tests add; a class with fewer than ``least`` estimated
    random strings adds none. The scored candidates are written once; they are far smaller than the texts.
    """
    done = materialise(scored(with_base(docs, id_col, text_col)), "secrets")
    return done.select("doc_id", *PATTERNS, picked(F.col("tokens"), limit_map(token_rows(done), fdr, storey, least)).alias("random"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, storey: float = 0.5, least: int = 2) -> DataFrame:
    """The documents with all spans in their text replaced by a mark; no join, so rows that share an id stay apart."""
    done = materialise(scored(with_base(docs, id_col, text_col)).select("tokens"), "secrets")
    limits = limit_map(token_rows(done), fdr, storey, least)
    rows = id_text(docs, id_col, text_col, carry=True).select("doc_id", "text", "row", *[spans_of(k).alias(k) for k in PATTERNS])
    spans = rows.select("text", "row", *PATTERNS, picked(tokens_of(), limits).alias("random"))
    clean = redacted(F.col("text"), all_spans(*KINDS))
    given = F.col(f"row.`{text_col}`")
    return spans.select(*[F.when(given.isNotNull(), clean).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with the united spans replaced; spans as scan_secrets gives them, for use in pipelines."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        ordered,
        start,
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"])), F.when(x["start"] >= acc["at"], F.lit(mask)).otherwise("")).alias("out"))
        ),
    )
    return F.concat(folded["out"], F.substr(text, folded["at"] + 1))


def all_spans(*kinds: str) -> Column:
    return F.concat(*[tagged(F.col(k), k) for k in kinds])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(joined(all_spans(*PATTERNS)), 256).alias("base_sha256"),
        joined(all_spans(*KINDS)).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
