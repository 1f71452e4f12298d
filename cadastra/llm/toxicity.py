"""Toxic passages as maximal scoring segments of token log-odds.

Training, on a bounded sample of labelled rows of which near copies of one class
count once: log-odds of each word between the classes under an informative
Dirichlet prior, over the documents that hold it, shrunk by the probability that
the word differs between the classes at all. That probability comes from a
mixture over all words (equal shares, or a share of its own), whose weight is
fitted to the counts, so it follows the number of documents and of words.
Scoring, on every row: the linear-time algorithm of Ruzzo and Tompa finds all
maximal segments of a text; each score is set against the extreme-value
distribution of chance segments (Karlin-Altschul), and the normalised excess of
the passages, fitted to the labels by a logistic curve, is the document's score.
Calibration and curve see only scores of documents that a model did not learn
from (one model for each fold).

Defined cases: a null or empty text has no passage and gets the lowest score; a
null doc_id is scored and not held out; labels that are null, or contradict each
other for one doc_id, are left out of training; without labels of both classes
nothing can be learnt and every score is 0; repeated rows are scored one by one;
a text of any length is scanned whole, and a long one needs more excess for the
same score, as chance segments grow with its words; segments that tie are all
found, equal texts get equal scores; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm import _text
from cadastra.llm._io import Scratch, small_batches
from cadastra.llm.decontaminate import WORD
from cadastra.llm.minhash import band_keys, signatures

#: At most so many labelled rows, those of least hash, are learnt from.
SAMPLE_ROWS = 20_000
#: The prior weighs so many words, or that share of the smaller class if it is less.
PRIOR_WORDS, PRIOR_SHARE = 1000.0, 0.05
#: A word scores if its shrunk log-odds reach LEAST_ODDS; every other word costs DRIFT.
LEAST_ODDS, DRIFT, THRESHOLD = 1.0, 0.05, 0.3
#: Training texts of one class that share a band of so many MinHash coordinates count once (97 % of pairs at similarity 0.9, 1 % at 0.3).
COPY_BANDS, COPY_ROWS = 4, 5
FOLDS = 4


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Count columns: documents of class 0 and 1 of each fold.
COUNTS = [f"f{k}n{c}" for k in range(FOLDS) for c in (0, 1)]


@dataclass
class Model:
    """Scored words (sorted hashes), extreme-value parameters, and the logistic curve over the passages' excess."""

    keys: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)


def segments(scores: list[float], places: list[int], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a sequence in one pass.

    scores are those of the listed places; every other place costs drift.
    """
    stack: list[tuple[float, float, int, int]] = []  # total before, total after, first, last
    total, at = 0.0, -1
    for place, score in zip(places, scores):
        total -= drift * (place - at - 1)
        at = place
        before, total = total, total + score
        if score <= 0:
            continue
        left, right, first = before, total, place
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, right, first, place))
    return [(a, b, y - x) for x, y, a, b in stack]


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, off in _text.chunks(column):
        data = _text.LOWER[data]
        starts, ends, at = _text.spans(data, off, WORD)
        yield a, b, _text.hashes(data, starts, ends), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word, by fold and class, of a few rows at a time; summed by Spark."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + toxic
        for a, b, h, at in _words(batch.column(2)):
            doc = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(at))
            _, once = np.unique(h ^ _text.mix64(doc + np.uint64(1)), return_index=True)
            keys, place = np.unique(h[once], return_inverse=True)
            n = np.bincount(place * (2 * FOLDS) + group[a:b][doc[once].astype(np.int64)], minlength=len(keys) * 2 * FOLDS).reshape(len(keys), 2 * FOLDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(n[:, k].astype(np.int64)) for k in range(2 * FOLDS))], names=["word", *COUNTS])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of texts with a shingle."""
    for batch in batches:
        for a, b, data, off in _text.chunks(batch.column(2)):
            sets = _text.shingle_sets(_text.LOWER[data], off)
            full = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
            sig = signatures([sets[i] for i in full], COPY_BANDS * COPY_ROWS) if len(full) else np.zeros((0, COPY_BANDS * COPY_ROWS), np.uint32)
            bands = band_keys(sig, COPY_BANDS, COPY_ROWS)
            own = [batch.column(c).slice(a, b - a).take(pa.array(full)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(bands[:, k]) for k in range(COPY_BANDS))], names=["key", "toxic", *(f"m{k}" for k in range(COPY_BANDS))])


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """sample (toxic, text) with one text of each class for each group that shares a band: that of least hash."""
    keyed = sample.withColumn("key", F.xxhash64("text", "toxic"))
    slim = keyed.select("key", "toxic", "text").mapInArrow(_bands, "key long, toxic int, " + ", ".join(f"m{k} long" for k in range(COPY_BANDS)))
    names = ["key", "toxic", *(f"m{k}" for k in range(COPY_BANDS))]
    for k in range(COPY_BANDS):
        slim = slim.groupBy(F.col("toxic").alias("class"), f"m{k}").agg(F.min(F.struct(*names)).alias("s")).select("s.*")
    return keyed.join(slim.select("key"), "key", "left_semi").dropDuplicates(["key"])


def passages(model: Model, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(words, maximal segments) of each document of a chunk."""
    low = np.minimum(np.searchsorted(model.keys, h), max(0, len(model.keys) - 1))
    hit = np.flatnonzero(model.keys[low] == h) if len(model.keys) else np.zeros(0, np.int64)
    score = model.scores[low[hit]] if len(hit) else np.zeros(0)
    cut = np.searchsorted(hit, at)
    for d in range(len(at) - 1):
        a, b = cut[d], cut[d + 1]
        own = score[a:b]
        yield int(at[d + 1] - at[d]), segments(own.tolist(), (hit[a:b] - at[d]).tolist(), DRIFT) if (own > 0).any() else []


def features(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """Excess of the best passage over chance, and the sum over all passages, in nats."""
    if not found:
        return 0.0, 0.0
    chance = math.log(max(model.scale * max(n, 1), 1.0))
    over = [max(0.0, model.rate * s - chance) for _, _, s in found]
    return min(max(over), 30.0), min(sum(over), 60.0)


def probability(model: Model, best: float, total: float) -> float:
    z = model.curve[0] + model.curve[1] * math.log1p(best) + model.curve[2] * math.log1p(total)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _keep(model, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            good = [probability(m, *features(m, n, found)) < threshold for _, _, h, at in _words(batch.column(text_at)) for n, found in passages(m, h, at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out: list[tuple] = []
            for _, _, h, at in _words(batch.column(1)):
                for n, found in passages(m, h, at):
                    good = [(a, b + 1) for a, b, s in found if m.rate * s > math.log(max(m.scale * n, 1.0))]
                    out.append((probability(m, *features(m, n, found)), len(good), ",".join(f"{a}:{b}" for a, b in good)))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.string())))], names=["key", "score", "n_passages", "passages"])

    return run


def _measure(models):
    """Features of each training row under the model that has not seen its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            fold = batch.column(1).to_pylist()
            for a, _, h, at in _words(batch.column(2)):
                for d in range(len(at) - 1):
                    m = models.value[fold[a + d]]
                    n, found = next(passages(m, h[at[d] : at[d + 1]], np.array([0, at[d + 1] - at[d]])))
                    out.append((*features(m, n, found), m.rate * max((s for *_, s in found), default=0.0), n))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(),) * 3 + (pa.int64(),)))], names=["toxic", "best", "total", "top", "n"])

    return run


_ln_gamma = np.vectorize(math.lgamma, otypes=[float])


def differing(n1: np.ndarray, n0: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Probability that a word with these counts has a share of toxic documents of its own; words counts those words.

    A mixture of two binomials, the common share and a uniformly distributed
    one; its weight is fitted by expectation maximisation. Words of one document
    tell nothing of the weight and get 0.
    """
    n1, n0 = n1.astype(float), n0.astype(float)
    share = (n1 * words).sum() / ((n1 + n0) * words).sum()
    own = _ln_gamma(n1 + 1) + _ln_gamma(n0 + 1) - _ln_gamma(n1 + n0 + 2)
    factor = np.exp(np.clip(own - n1 * math.log(share) - n0 * math.log(1 - share), -600, 600))
    words = np.where(n1 + n0 > 1, words, 0)
    weight = 0.01
    for _ in range(100 if words.sum() else 0):
        weight = min(max((words * weight * factor / (1 - weight + weight * factor)).sum() / words.sum(), 1e-9), 0.5)
    return np.where(n1 + n0 > 1, weight * factor / (1 - weight + weight * factor), 0.0)


def word_scores(n1: np.ndarray, n0: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores of words with these counts (0: not scored), and the rate at which e to the scores has mean 1 in clean text.

    Log-odds under a Dirichlet prior of the words' own shares, times the
    probability that the word differs between the classes.
    """
    all1, all0 = float((n1 * words).sum()), float((n0 * words).sum())
    weight = min(PRIOR_WORDS, PRIOR_SHARE * min(all1, all0))
    prior = weight * (n1 + n0) / (all1 + all0)
    a1, a0 = n1 + prior, n0 + prior
    odds = np.log(a1 / (all1 + weight - a1)) - np.log(a0 / (all0 + weight - a0))
    odds *= differing(n1, n0, words)
    on = np.abs(odds) >= LEAST_ODDS
    scores = np.where(on, np.maximum(odds, -1.0) - DRIFT, 0.0)
    share = np.where(on, words * a0 / (all0 + weight), 0.0)
    rate = 1.0
    if (scores > 0).any():
        low, high = 1e-6, 50.0
        for _ in range(80):
            rate = (low + high) / 2
            with np.errstate(over="ignore"):
                mean = (share * np.exp(rate * scores)).sum() + (1 - share.sum()) * math.exp(-rate * DRIFT)
            low, high = (low, rate) if mean > 1 else (rate, high)
    return scores, rate


def _models(counts: DataFrame) -> list[Model]:
    """A model without each fold, and at the end one of all rows; empty where a class is missing.

    Words of equal counts score alike, so the driver sees the distinct pairs of
    counts and the words that score, never the vocabulary.
    """
    spark = counts.sparkSession
    total = [sum((F.col(f"f{k}n{c}") for k in range(FOLDS)), F.lit(0)) for c in (0, 1)]
    less = [F.struct(F.lit(k).cast("int").alias("model"), *[(t - (F.col(f"f{k}n{c}") if k < FOLDS else F.lit(0))).cast("long").alias(f"n{c}") for c, t in enumerate(total)]) for k in range(FOLDS + 1)]
    each = counts.select("word", F.explode(F.array(*less)).alias("m")).select("word", "m.*").where("n0 + n1 > 0")
    pairs = each.groupBy("model", "n1", "n0").agg(F.count(F.lit(1)).alias("words")).orderBy("model", "n1", "n0").collect()
    rates, scored = {}, []
    for k in range(FOLDS + 1):
        n1, n0, words = (np.array([r[c] for r in pairs if r.model == k], np.int64) for c in ("n1", "n0", "words"))
        if (n1 * words).sum() and (n0 * words).sum():
            scores, rates[k] = word_scores(n1, n0, words)
            scored += [(k, int(a), int(b), float(s)) for a, b, s in zip(n1, n0, scores) if s]
    table = F.broadcast(spark.createDataFrame(scored, "model int, n1 long, n0 long, score double"))  # distinct pairs of counts
    rows = each.join(table, ["model", "n1", "n0"]).select("model", "word", "score").toArrow()
    model, word, score = (rows.column(c).to_numpy() for c in ("model", "word", "score"))
    out = []
    for k in range(FOLDS + 1):
        keys = word[model == k].view(np.uint64)
        order = np.argsort(keys)
        out.append(Model(keys[order], score[model == k][order], rates.get(k, 1.0)))
    return out if FOLDS in rates else []


def train(docs: DataFrame, labels: DataFrame, tmp: Scratch, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model on at most sample_rows labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    known = known.where((F.col("low") == F.col("high")) & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("low") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text").where("text is not null")  # sample_rows at most
    sample = tmp.save(_one_of_copies(sample).select("toxic", F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold"), "text"), "sample")
    counts = sample.mapInArrow(_count, "word long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    models = _models(tmp.save(counts, "counts"))
    if not models:
        return Model(np.zeros(0, np.uint64), np.zeros(0), curve=(-30.0, 0.0, 0.0))

    def measured() -> np.ndarray:
        got = sample.mapInArrow(_measure(spark.sparkContext.broadcast(models)), "toxic int, best double, total double, top double, n long")
        return np.array(sorted(tuple(r) for r in got.collect()), float)

    x = measured()
    clean_rows = x[x[:, 0] == 0]
    hit = clean_rows[clean_rows[:, 3] > 0]
    if len(hit):
        chance = hit[:, 3] - np.log(hit[:, 4])
        scale = float(np.exp(np.clip(chance.mean() - 0.5772, -20, 5)))  # the mean of a Gumbel variable
    else:  # no chance segment in all the clean words
        scale = 1 / max(1.0, float(clean_rows[:, 4].sum()))
    for m in models:
        m.scale = scale
    x = measured()
    models[-1].curve = _logistic(np.log1p(x[:, 1:3]), x[:, 0])
    return models[-1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method for a logistic curve."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, n_passages, passages (word start:end)."""
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "toxicity")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(train(source, labels, tmp, sample_rows=sample_rows))
    tmp.drop("sample", "counts")
    scored = source.mapInArrow(_apply(model), "key long, score double, n_passages long, passages string")
    return scored.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose score is below threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "toxicity")
    model = spark.sparkContext.broadcast(train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, tmp, sample_rows=sample_rows))
    tmp.drop("sample", "counts")
    return docs.mapInArrow(_keep(model, threshold, docs.columns.index("text")), docs.schema)
