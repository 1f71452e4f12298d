"""Secret scan by patterns and by a battery of randomness tests, in the JVM alone.

Patterns find assigned values, access keys and long hex runs. Besides, every
long token that mixes letters and digits is judged twice, under the encoding
inferred from its characters:

* A battery asks whether it may be uniformly random: a chi-squared test of its
  alphabet, a runs test about the middle of the alphabet, and a test of serial
  correlation. A combined p-value under `level` makes it ordinary text.
* The ratio of its likelihood as ordinary text (a chain of character classes and
  the characters in each, fitted to the distinct tokens of the table that fail
  the battery, over fixed prior counts) to that as random text. Under ordinary
  text the ratio is at most 1 on average, so it bounds a p-value.

Benjamini-Hochberg control of the second p-values within each class of lengths,
over distinct tokens, bounds by `rate` the share of ordinary tokens among those
reported, which have kind `random`. A token's fate so depends on the other
tokens of its length in the table.

Defined cases: a null or empty text has no span (empty string, hash of the empty
string); spans that overlap a pattern's are not added; ties sort by kind as
listed; repeated rows and null ids are scanned one by one; whole texts are
scanned, whatever their length; an empty table gives an empty result; other
columns of the input are kept only by redact(), whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm._io import Scratch
from cadastra.llm._native import NO_SPANS, cut_out, places, unused

KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is maximal, so the least length can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Candidates of the battery: runs of so many characters with a digit and a letter.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Name, alphabet pattern, alphabet.
ENCODINGS = (
    ("hex", "[0-9a-f]+", "0123456789abcdef"),
    ("HEX", "[0-9A-F]+", "0123456789ABCDEF"),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "[0-9A-Za-z+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "[0-9A-Za-z_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: The share of ordinary tokens among those reported; the battery's level; evidence counts in steps of 1 / STEPS nats, up to BINS.
FALSE_DISCOVERY_RATE, LEVEL, STEPS, BINS = 0.01, 0.001, 4, 400
#: Ordinary text: characters by class, and prior counts of going on in a class, of leaving it for another, and of a character.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")
ALL = "".join(CLASSES)
STAY, LEAVE, CHARACTER = 120.0, 15.0, 10.0


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.when(text.rlike(pattern), places(text, F.lit(pattern), group)).otherwise(F.expr(NO_SPANS))


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution (logistic approximation, within 0.0002)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(80.0))))


def p_value(token: Column, alphabet: Column) -> Column:
    """Three times the least p-value of the battery, at most 1, for a token over an alphabet."""
    size, n = F.length(alphabet).cast("double"), F.length(token).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    chi = (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double"))
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("last", -1.0), ("runs", 0.0), ("high", 0.0), ("sum", 0.0), ("square", 0.0), ("cross", 0.0))])

    def step(a: Column, x: Column) -> Column:
        high = x > size / 2
        new = F.when((a["last"] < 0) | ((a["last"] > size / 2) != high), 1.0).otherwise(0.0)
        cross = F.when(a["last"] < 0, 0.0).otherwise(a["last"] * x)
        return F.struct(x.alias("last"), (a["runs"] + new).alias("runs"), (a["high"] + high.cast("double")).alias("high"), (a["sum"] + x).alias("sum"), (a["square"] + x * x).alias("square"), (a["cross"] + cross).alias("cross"))

    def finish(a: Column) -> Column:
        up, down = a["high"], n - a["high"]
        mean = 1 + 2 * up * down / n
        var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        runs = 2 * _tail(F.abs(a["runs"] - mean) / F.sqrt(var))
        mu = a["sum"] / n
        spread = F.greatest(a["square"] - n * mu * mu, F.lit(1e-9))
        serial = 2 * _tail(F.abs(a["cross"] - (n - 1) * mu * mu) / spread * F.sqrt(n))
        return F.least(F.lit(1.0), 3 * F.least(_tail(chi), runs, serial))

    return F.aggregate(codes, start, step, finish)


@dataclass(frozen=True)
class Ordinary:
    """Log-likelihoods of ordinary text: of each class after each (the last row: at the start), and of each character in its class."""

    moves: tuple[float, ...]
    characters: tuple[float, ...]
    #: For each length class, the least evidence (in steps) of a token that is reported.
    limits: tuple[tuple[int, int], ...] = ()


def fit_ordinary(counts: dict[tuple[int, str], int]) -> Ordinary:
    """From counts of (class before, or 4 at the start; character)."""
    of = {c: k for k, letters in enumerate(CLASSES) for c in letters}
    moves = [[STAY if j == k else LEAVE for k in range(4)] if j < 4 else [LEAVE] * 4 for j in range(5)]
    characters = dict.fromkeys(ALL, CHARACTER)
    for (before, c), n in counts.items():
        moves[before][of[c]] += n
        characters[c] += n
    whole = [sum(characters[c] for c in letters) for letters in CLASSES]
    return Ordinary(tuple(math.log(x / sum(row)) for row in moves for x in row), tuple(math.log(characters[c] / whole[of[c]]) for c in ALL))


def _class(place: Column) -> Column:
    """The class of a character by its place in ALL, from 1."""
    return F.when(place <= 26, 0).when(place <= 52, 1).when(place <= 62, 2).otherwise(3)


def evidence(token: Column, alphabet: Column, model: Ordinary) -> Column:
    """Steps of log-likelihood of a token as random text over that as ordinary text, at least 0."""
    moves, characters = (F.array(*[F.lit(x) for x in v]) for v in (model.moves, model.characters))
    start = F.struct(F.lit(4).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        place = F.instr(F.lit(ALL), c)
        return F.struct(_class(place).alias("last"), (a["sum"] + F.element_at(moves, a["last"] * 4 + _class(place) + 1) + F.element_at(characters, place)).alias("sum"))

    ordinary = F.aggregate(F.split(token, ""), start, step, lambda a: a["sum"])
    nats = -F.length(token) * F.log(F.length(alphabet).cast("double")) - ordinary
    return F.least(F.greatest(F.floor(nats * STEPS), F.lit(0)), F.lit(BINS)).cast("int")


def _body(token: Column) -> Column:
    return F.rtrim(token, F.lit("="))


def _alphabet(body: Column) -> Column:
    kind = F.lit(ENCODINGS[-1][2])
    for _, pattern, letters in ENCODINGS[-2::-1]:
        kind = F.when(body.rlike(f"^{pattern}$"), F.lit(letters)).otherwise(kind)
    return kind


def _length_class(body: Column) -> Column:
    return F.least(F.floor(F.log2(F.length(body))), F.lit(12)).cast("int")


def control(rows: list[tuple[int, int, int]], rate: float) -> tuple[tuple[int, int], ...]:
    """Benjamini-Hochberg within each class of (class, evidence in steps, tokens): (class, least evidence reported)."""
    out = []
    for klass in sorted({k for k, _, _ in rows}):
        own = sorted(((e, n) for k, e, n in rows if k == klass), reverse=True)
        whole, above, least = sum(n for _, n in own), 0, None
        for e, n in own:
            above += n
            if math.exp(-e / STEPS) <= rate * above / whole:
                least = e
        if least is not None:
            out.append((klass, least))
    return tuple(out)


def learn(docs: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE, level: float = LEVEL) -> Ordinary:
    """The model of ordinary tokens and the limits, over all documents.

    One scan writes the distinct candidates; only counts by class and character,
    and by length class and evidence, come to the driver.
    """
    tmp = Scratch(docs.sparkSession, "secrets")
    found = F.transform(_found(F.coalesce(F.col(text_col), F.lit("")), TOKEN), lambda m: _body(m["part"]))
    tokens = docs.select(F.explode(found).alias("token")).groupBy("token").agg(F.lit(1).alias("one")).select("token", _alphabet(F.col("token")).alias("alphabet"))
    tokens = tmp.save(tokens.withColumn("fails", p_value(F.col("token"), F.col("alphabet")) < level), "tokens")
    chars = tokens.where("fails").select(F.split("token", "").alias("c")).select(F.explode(F.transform("c", lambda c, i: F.struct(F.when(i == 0, 4).otherwise(_class(F.instr(F.lit(ALL), F.element_at(F.col("c"), F.greatest(i, F.lit(1)))))).alias("before"), c.alias("c")))).alias("z")).select("z.*")
    model = fit_ordinary({(r.before, r.c): r.n for r in chars.groupBy("before", "c").agg(F.count(F.lit(1)).alias("n")).collect()})
    judged = tokens.select(_length_class(F.col("token")).alias("klass"), F.when(F.col("fails"), 0).otherwise(evidence(F.col("token"), F.col("alphabet"), model)).alias("steps"))
    rows = judged.groupBy("klass", "steps").agg(F.count(F.lit(1)).alias("n")).collect()
    tmp.drop("tokens")
    return Ordinary(model.moves, model.characters, control([(r.klass, r.steps, r.n) for r in rows], rate))


def _random(text: Column, model: Ordinary, level: float) -> Column:
    """The tokens reported as random."""
    if not model.limits:
        return F.expr(NO_SPANS)
    limits = F.create_map(*[F.lit(x) for pair in model.limits for x in pair])

    def good(m: Column) -> Column:
        body = _body(m["part"])
        enough = evidence(body, _alphabet(body), model) >= F.coalesce(F.element_at(limits, _length_class(body)), F.lit(BINS + 1))
        return enough & (p_value(body, _alphabet(body)) >= level)

    return F.filter(_found(text, TOKEN), good)


def _with_spans(docs: DataFrame, text: Column, model: Ordinary, level: float) -> tuple[DataFrame, str]:
    """docs with arrays of (at, rank, to, kind) by start and then kind, in columns of a prefix that docs doesn't use."""
    p = unused(docs)
    df = docs.withColumn(f"{p}text", F.coalesce(text, F.lit("")))
    whole = F.col(f"{p}text")
    assign = F.filter(_found(whole, ASSIGN, 1), lambda m: F.length(m["part"]) >= LEAST_VALUE)
    df = df.withColumns({f"{p}assign": assign, f"{p}access": _found(whole, ACCESS), f"{p}hex": _found(whole, HEX), f"{p}random": _random(whole, model, level)})

    def keyed(kind: str, rank: int) -> Column:
        return F.transform(f"{p}{kind}", lambda m: F.struct(m["at"].alias("at"), F.lit(rank).alias("rank"), m["to"].alias("to"), F.lit(kind).alias("kind")))

    df = df.withColumn(f"{p}base", F.array_sort(F.concat(keyed("assign", 0), keyed("access", 1), keyed("hex", 2))))
    more = F.filter(keyed("random", 3), lambda m: ~F.exists(f"{p}base", lambda b: (b["at"] < m["to"]) & (m["at"] < b["to"])))
    return df.withColumn(f"{p}all", F.array_sort(F.concat(f"{p}base", more))), p


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["to"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE, level: float = LEVEL) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    df, p = _with_spans(source, F.col("text"), learn(source, rate=rate, level=level), level)
    sizes = [F.size(f"{p}{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return df.select("doc_id", *sizes, F.sha2(_joined(f"{p}base"), 256).alias("base_sha256"), _joined(f"{p}all").alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[REDACTED]", rate: float = FALSE_DISCOVERY_RATE, level: float = LEVEL) -> DataFrame:
    """docs, all rows and columns, with every span of every text replaced by mark; null texts stay null."""
    df, p = _with_spans(docs, F.col(text_col), learn(docs, text_col, rate, level), level)
    text = F.when(F.size(f"{p}all") == 0, F.col(text_col)).otherwise(cut_out(F.col(f"{p}text"), F.col(f"{p}all"), mark))
    return df.withColumn(f"{p}out", text).select(*[F.col(f"{p}out" if c == text_col else f"`{c}`").alias(c) for c in docs.columns])
