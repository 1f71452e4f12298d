"""Quality rules: counts over a text, and a linear-chain CRF over its lines.

Every line with a word is labelled content or boilerplate by Viterbi decoding of
a conditional random field with two states; the share of characters in content
lines decides whether a document that passes the base rules is kept. The field
is trained here on a bounded sample of documents with quality labels. The labels
of their lines are hidden: all lines start with their document's label, from
which the features alone are learnt; then a decoding of the lines and gradient
ascent on the whole field take turns, where the decoding of a document must give
a content share on its label's side. So a good document may hold boilerplate and
a bad one content, and the moves between the two are learnt.

Defined cases: a null or empty text has no word and fails the base rules; a
document without lines has content share 0; null or contradicting labels are left
out of training, as are the rows that held_out of the toxicity scan names;
without labels of both classes every line is content; a tie of the two states
goes to boilerplate, one of the shares to keeping; texts are read whole, and of
a very long training document SEGMENTS stretches of LINES lines are learnt from;
repeated rows and null ids are judged one by one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm import _text
from cadastra.llm._io import small_batches
from cadastra.llm.toxicity import held_out

#: At most so many labelled documents, those of least hash, train the field.
SAMPLE_ROWS, LEAST_SHARE = 800, 0.5
#: A training document gives so many stretches of so many lines at most.
SEGMENTS, LINES = 8, 256
#: Gradient steps before the lines are first labelled anew, steps after each labelling, and labellings.
FIRST_STEPS, STEPS, ROUNDS = 40, 15, 4


def _set(chars: str) -> np.ndarray:
    x = np.zeros(256, bool)
    x[[ord(c) for c in chars]] = True
    return x


SYMBOL = _set("#*$%&|<>")
DIGIT, UPPER = _set("0123456789"), _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = _set("abcdefghijklmnopqrstuvwxyz") | UPPER
LETTER[128:] = True
MARK = ~(LETTER | DIGIT | _set(" \t\n\r\v\f.,"))
NEWLINE = ~_set("\n")
HEAD = np.ones(256, bool)
HEAD[0x80:0xC0] = False
FEATURES = 14


def _per(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether it occurs again, and whether an equal one comes before."""
    _, first, place, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return n[place] > 1, first[place] != np.arange(len(keys))


def describe(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each document of a chunk, and lines: features, characters, lines before each document."""
    n = len(off) - 1
    starts, ends, at = _text.spans(data, off, _text.NOT_SPACE)
    h = _text.hashes(data, starts, ends)
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    inside = _text.NOT_SPACE[data]
    salt = _text.mix64(np.arange(1, n + 1, dtype=np.uint64))
    three = _text.windows(h, 3)
    valid = np.flatnonzero(np.arange(len(three)) + 3 <= at[doc[: len(three)] + 1]) if len(three) else np.zeros(0, np.int64)
    again, _ = _repeats(three[valid] ^ salt[doc[valid]])
    covered = np.zeros(len(h) + 3, bool)
    for k in range(3):
        covered[valid[again] + k] = True
    covered = covered[: len(h)]
    ls, le, lat = _text.spans(data, off, NEWLINE)
    word_count = np.searchsorted(starts, le) - np.searchsorted(starts, ls)
    full = word_count > 0
    ls, le, word_count = ls[full], le[full], word_count[full]
    lat = np.concatenate([[0], np.cumsum(full)])[lat]
    line_doc = np.repeat(np.arange(n), np.diff(lat))
    _, dup = _repeats(_text.hashes(data, ls, le) ^ salt[line_doc])
    size = _per(HEAD[data], ls, le)
    first_word = np.searchsorted(starts, ls)
    repeat = _per(covered, first_word, first_word + word_count) / word_count
    share = [_per(table[data], ls, le) / np.maximum(le - ls, 1) for table in (SYMBOL, DIGIT, UPPER, MARK)]
    last = data[np.maximum(le - 1, 0)] if len(le) else np.zeros(0, np.uint8)
    x = np.column_stack([
        np.ones(len(ls)), dup, word_count <= 2, word_count <= 5, word_count >= 12, share[0] > 0.01, share[0] > 0.08, share[1] > 0.1, share[2] > 0.3,
        share[3] > 0.05, share[3] > 0.15, repeat > 0.5, (last == 46) | (last == 33) | (last == 63), size / np.maximum(word_count, 1) > 12,
    ]).astype(float) if len(ls) else np.zeros((0, FEATURES))
    sums = lambda flags, a: np.diff(np.concatenate([[0], np.cumsum(flags)])[a])
    return {
        "n_words": words, "word_chars": sums(HEAD[data] & inside, off), "n_symbols": sums(SYMBOL[data], off), "n_dup_lines": sums(dup, lat), "n_repeat_words": sums(covered, at),
        "x": x, "size": size, "lines": lat,
    }


def viterbi(emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest labels (1 content, 0 boilerplate) of one sequence."""
    n = len(emission)
    if not n:
        return np.zeros(0, np.int64)
    e = emission.tolist()
    (m00, m01), (m10, m11) = move.tolist()
    a, b = e[0]
    back = []
    for p, q in e[1:]:
        from0, from1 = b + m10 > a + m00, b + m11 > a + m01
        back.append((from0, from1))
        a, b = (b + m10 if from0 else a + m00) + p, (b + m11 if from1 else a + m01) + q
    out = [int(b > a)]
    for pair in reversed(back):
        out.append(int(pair[out[-1]]))
    return np.array(out[::-1], np.int64)


@dataclass
class Batch:
    """Sequences of like length, padded: features, line sizes, lines of each, and whether its document is good."""

    x: np.ndarray
    size: np.ndarray
    n: np.ndarray
    good: np.ndarray

    @property
    def inside(self) -> np.ndarray:
        return np.arange(self.x.shape[1]) < self.n[:, None]


def batches_of(sequences: list[tuple[np.ndarray, np.ndarray, int]]) -> list[Batch]:
    """Batches whose padding at most doubles a sequence."""
    out = []
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: len(s[0]))
    while sequences:
        group = [s for s in sequences if len(s[0]) <= 2 * len(sequences[0][0])]
        sequences = sequences[len(group) :]
        n = np.array([len(s[0]) for s in group])
        x, size = np.zeros((len(group), n.max(), FEATURES)), np.zeros((len(group), n.max()))
        for k, (rows, sizes, _) in enumerate(group):
            x[k, : n[k]], size[k, : n[k]] = rows, sizes
        out.append(Batch(x, size, n, np.array([s[2] for s in group])))
    return out


def gradient(batch: Batch, labels: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labelled sequences, each weighed by one over its lines, and its gradient."""
    e, (many, longest) = batch.x @ w, labels.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, longest):
        alpha[:, t] = e[:, t] + np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1])
    for t in range(longest - 2, -1, -1):
        s = e[:, t + 1] + beta[:, t + 1]
        before = np.logaddexp(move[:, 0] + s[:, :1], move[:, 1] + s[:, 1:])
        beta[:, t] = np.where((t + 1 < batch.n)[:, None], before, 0.0)
    last = alpha[np.arange(many), batch.n - 1]
    z = np.logaddexp(last[:, 0], last[:, 1])
    inside, weight = batch.inside, 1.0 / batch.n
    p = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
    seen = np.stack([labels == 0, labels == 1], -1) * inside[..., None]
    g = np.einsum("ntf,nts,n->fs", batch.x, seen - p, weight)
    pair = alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
    both = inside[:, 1:, None, None]
    held = seen[:, :-1, :, None] * seen[:, 1:, None, :]
    m = ((held - np.exp(np.where(both, pair, -np.inf))) * both * weight[:, None, None, None]).sum((0, 1))
    value = ((e * seen).sum((1, 2)) + (held * both * move).sum((1, 2, 3)) - z) @ weight
    return float(value), g, m


def decode(batch: Batch, w: np.ndarray, move: np.ndarray, least_share: float) -> np.ndarray:
    """Likeliest labels of each sequence whose content share lies on the side of its document's label.

    Where it doesn't, the state asked for gets a growing bonus in every line.
    """
    out = np.zeros(batch.size.shape, np.int64)
    for k, (n, good) in enumerate(zip(batch.n, batch.good)):
        e, size, bonus = batch.x[k, :n] @ w, batch.size[k, :n], 0.0
        while True:
            y = viterbi(e, move)
            if (size @ y >= least_share * size.sum()) == bool(good):
                break
            if bonus > 64:
                y = np.full(n, good)
                break
            step = max(0.25, bonus)
            e = e + step * np.array([1 - good, good])
            bonus += step
        out[k, :n] = y
    return out


def fit(batches: list[Batch], least_share: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, moves) from documents whose line labels are hidden."""
    w, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    many = sum(len(b.n) for b in batches)
    labels = [np.repeat(b.good[:, None], b.x.shape[1], 1) for b in batches]
    sum_w, sum_m = np.full_like(w, 1e-8), np.full_like(move, 1e-8)
    for r in range(ROUNDS):
        for _ in range(STEPS if r else FIRST_STEPS):
            g, m = -0.002 * w * many, -0.002 * move * many
            for b, y in zip(batches, labels):
                _, dg, dm = gradient(b, y, w, move)
                g, m = g + dg, m + dm
            sum_w, sum_m = sum_w + g * g, sum_m + m * m
            w = w + 0.5 * g / np.sqrt(sum_w)
            if r:  # labels that are equal in every document would teach no move
                move = move + 0.5 * m / np.sqrt(sum_m)
        labels = [decode(b, w, move, least_share) for b in batches]
    return w, move


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, least_share: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, moves) of the field; rows that are held out teach nothing."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", (F.col("low") > 0).cast("int").alias("good"))
    texts = docs.join(F.broadcast(chosen), "doc_id").where("text is not null").select("good", "text").dropDuplicates()  # sample_rows at most
    rows = texts.mapInArrow(_features, "good int, x array<double>, size array<long>").collect()
    sample = [(np.array(r.x).reshape(-1, FEATURES), np.array(r.size, float), r.good) for r in sorted(rows, key=lambda r: (r.good, r.size, r.x))]
    if len({y for x, _, y in sample if len(x)}) < 2:
        w = np.zeros((FEATURES, 2))
        w[0, 1] = 1.0
        return w, np.zeros((2, 2))
    return fit(batches_of(sample), least_share)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of LINES lines of each text, evenly dealt, SEGMENTS at most."""
    for batch in batches:
        for a, _, data, off in _text.chunks(batch.column(1)):
            got = describe(data, off)
            row, x, size = [], [], []
            for d, (p, q) in enumerate(zip(got["lines"][:-1], got["lines"][1:])):
                starts = np.arange(p, q, LINES)
                for s in starts[np.unique(np.linspace(0, len(starts) - 1, min(len(starts), SEGMENTS)).astype(np.int64))] if len(starts) else []:
                    row.append(a + d)
                    x.append(got["x"][s : min(s + LINES, q)].ravel())
                    size.append(got["size"][s : min(s + LINES, q)])
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(x, pa.list_(pa.float64())), pa.array(size, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["good", "x", "size"])


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, move = model.value
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            for a, b, data, off in _text.chunks(batch.column(1)):
                got = describe(data, off)
                e, lat, size = got["x"] @ w, got["lines"], got["size"]
                label = np.concatenate([np.zeros(0, np.int64), *(viterbi(e[p:q], move) for p, q in zip(lat[:-1], lat[1:]))])
                per = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[lat])
                whole, content = per(size), per(size * label)
                share = content / np.maximum(whole, 1)
                cols = [pa.array(got[c].astype(np.int64)) for c in names] + [pa.array(np.diff(lat).astype(np.int64)), pa.array(per(label).astype(np.int64)), pa.array(share)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=["doc_id", *names, "n_lines", "content_lines", "content_share"])

    return run


def judge_quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept, and the content lines and share."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(train(source, labels, sample_rows=sample_rows, least_share=least_share))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    df = source.mapInArrow(_judge(model), f"doc_id long, {counts}, n_lines long, content_lines long, content_share double")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    names = [x.split()[0] for x in counts.split(", ")]
    return df.select("doc_id", *names, failed.alias("base_failed"), (~failed & (F.col("content_share") >= least_share)).alias("kept"), "n_lines", "content_lines", "content_share")
