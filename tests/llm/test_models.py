"""The trained models: their formulas against plain versions, and their verdicts on planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import line_quality, toxicity


def test_differing_is_the_posterior_of_the_mixture():
    n1, n0, words = np.array([0, 1, 2, 3, 9, 2, 1]), np.array([1, 0, 0, 0, 0, 16, 11]), np.array([900, 100, 2, 1, 3, 40, 30])
    got = toxicity.differing(n1, n0, words)
    share = sum(n1 * words) / sum((n1 + n0) * words)
    factor = [math.factorial(a) * math.factorial(b) / math.factorial(a + b + 1) / (share**a * (1 - share) ** b) for a, b in zip(n1.tolist(), n0.tolist())]
    weight = 0.01
    for _ in range(100):
        weight = sum(w * weight * f / (1 - weight + weight * f) for f, w, a, b in zip(factor, words, n1, n0) if a + b > 1) / sum(w for w, a, b in zip(words, n1, n0) if a + b > 1)
    want = [weight * f / (1 - weight + weight * f) if a + b > 1 else 0.0 for f, a, b in zip(factor, n1, n0)]
    assert got == pytest.approx(want) and got[4] > 0.9 and got[0] == got[1] == 0


def test_word_scores_are_shrunk_log_odds_and_the_rate_solves_its_equation():
    n1, n0, words = np.array([0, 1, 30, 40, 0]), np.array([1, 0, 0, 400, 60]), np.array([500, 60, 4, 50, 3])
    scores, rate = toxicity.word_scores(n1, n0, words)
    all1, all0 = sum(n1 * words), sum(n0 * words)
    weight = min(1000.0, 0.05 * min(all1, all0))
    for a, b, p, s in zip(n1, n0, toxicity.differing(n1, n0, words), scores):
        prior = weight * (a + b) / (all1 + all0)
        odds = math.log((a + prior) / (all1 + weight - a - prior)) - math.log((b + prior) / (all0 + weight - b - prior))
        assert s == pytest.approx(max(p * odds, -1) - 0.05 if abs(p * odds) >= 1 else 0)
    share = [w * (b + weight * (a + b) / (all1 + all0)) / (all0 + weight) if s else 0 for a, b, w, s in zip(n1, n0, words, scores)]
    assert scores[2] > 1 and sum(q * math.exp(rate * s) for q, s in zip(share, scores)) + (1 - sum(share)) * math.exp(-0.05 * rate) == pytest.approx(1, abs=1e-6)


def _texts(rng, n, vile):
    calm = lambda: " ".join(rng.choice(["calm", "word", "tree", "stone", "river", "cloud", "quiet", "green"]) for _ in range(25))
    return [(i, f"{calm()} {'vile ' if vile(i) else ''}{calm()}") for i in range(n)]


def test_labels_of_one_class_drop_nothing(spark):
    docs = spark.createDataFrame(_texts(random.Random(1), 12, lambda i: i % 2), "doc_id long, text string")
    for toxic in (0, 1):
        tags = docs.select("doc_id", F.lit(toxic).alias("toxic"))
        assert toxicity.drop_toxic(docs, tags).count() == 12
        assert {round(r.score, 9) for r in toxicity.score_toxicity(docs, tags).collect()} == {0.0}


def test_copies_of_one_class_count_once(spark):
    rows = _texts(random.Random(2), 40, lambda i: i % 2)
    sample = spark.createDataFrame([(i % 2, t) for i, t in rows] + [(1, rows[1][1])] * 9 + [(1, rows[1][1] + " end")] * 3 + [(0, rows[1][1])] * 2, "toxic int, text string")
    kept = toxicity._one_of_copies(sample).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in kept} == {0: 21, 1: 20}


def test_long_and_tied_texts(spark):
    rows = _texts(random.Random(3), 150, lambda i: i % 3 == 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tags = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    more = [(1000, "calm river " * 100_000), (1001, "calm river " * 50_000 + "vile vile vile vile " + "calm stone " * 50_000), (1002, rows[0][1]), (1002, rows[0][1])]
    got = {}
    for r in toxicity.score_toxicity(docs.union(spark.createDataFrame(more, docs.schema)), tags).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[1000] == [min(min(v) for v in got.values())] and got[1001][0] > 0.3 and got[1002] == got[0] * 2


def _sequences(rng, n=6):
    return [(rng.normal(size=(k, line_quality.FEATURES)), rng.integers(1, 50, k).astype(float), int(k % 2)) for k in rng.integers(1, 6, n)]


def test_field_likelihood_and_gradient():
    rng = np.random.default_rng(3)
    (batch, *_), w, move = line_quality.batches_of(_sequences(rng)), rng.normal(size=(line_quality.FEATURES, 2)) / 3, rng.normal(size=(2, 2))
    labels = rng.integers(0, 2, batch.size.shape)
    value, g, m = line_quality.gradient(batch, labels, w, move)
    plain = 0.0
    for x, n, y in zip(batch.x, batch.n, labels):
        score = lambda y: sum((x[i] @ w)[y[i]] for i in range(n)) + sum(move[a, b] for a, b in zip(y[: n - 1], y[1:n]))  # noqa: E731,B023
        plain += (score(y) - np.logaddexp.reduce([score([k >> i & 1 for i in range(n)]) for k in range(1 << n)])) / n
    assert value == pytest.approx(plain)
    for at in ((0, 0), (5, 1), (13, 0)):
        near = w.copy()
        near[at] += 1e-6
        assert (line_quality.gradient(batch, labels, near, move)[0] - value) / 1e-6 == pytest.approx(g[at], abs=1e-4)
    for at in ((0, 1), (1, 1)):
        near = move.copy()
        near[at] += 1e-6
        assert (line_quality.gradient(batch, labels, w, near)[0] - value) / 1e-6 == pytest.approx(m[at], abs=1e-4)


def test_decoding_keeps_to_the_document_label():
    rng = np.random.default_rng(4)
    for batch in line_quality.batches_of(_sequences(rng, 40)):
        w, move = rng.normal(size=(line_quality.FEATURES, 2)), rng.normal(size=(2, 2))
        y = line_quality.decode(batch, w, move, 0.5)
        share = (batch.size * y).sum(1) / batch.size.sum(1)
        assert ((share >= 0.5) == (batch.good == 1)).all()


def test_lines_of_mixed_documents_are_told_apart(spark):
    """Good documents with menus and bad ones with some prose: only documents are labelled, lines are judged."""
    rng = random.Random(7)
    prose = lambda: " ".join(rng.choices(["the", "river", "runs", "under", "an", "old", "bridge", "near", "town", "slowly"], k=rng.randint(14, 25))).capitalize() + f" number {rng.randrange(10**6)}."
    menu = lambda: " | ".join(rng.choices(["home", "login", "share", "cart", "#top", "help"], k=rng.randint(3, 8))) + f" | {rng.randrange(10**6)} |"
    rows, truth = [], {}
    for i in range(400):
        good = i % 3 > 0
        lines = [(1, prose()) if rng.random() < (0.8 if good else 0.25) else (0, menu()) for _ in range(rng.randint(8, 20))]
        size = [sum(len(t) for y, t in lines if y == k) for k in (0, 1)]
        if (size[1] >= size[0]) == good:
            rows.append((i, "\n".join(t for _, t in lines)))
            truth[i] = good, sum(y for y, _ in lines), len(lines)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, (g, _, _) in truth.items()], "doc_id long, quality int")
    got = line_quality.judge_quality(docs, labels).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    wrong = sum(abs(r.content_lines - truth[r.doc_id][1]) for r in got)
    held = [r for r in got if r.held and not r.base_failed]
    assert wrong <= 0.02 * sum(n for *_, n in truth.values()) and held and all(r.kept == truth[r.doc_id][0] for r in held)
    w, move = line_quality.train(docs, labels)
    assert abs(move).max() < 2.5


def test_quality_of_labelled_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = line_quality.judge_quality(docs, labels).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in held) >= 0.95 * len(held) and len(held) > 60


def test_a_very_long_training_document_gives_stretches(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(6000))
    rows = spark.createDataFrame([(1, text), (0, "a\nb"), (1, None), (1, "")], "good int, text string").mapInArrow(line_quality._features, "good int, x array<double>, size array<long>").collect()
    assert sorted((r.good, len(r.size)) for r in rows) == [(0, 2)] + sorted([(1, 256)] * 7 + [(1, 6000 % 256)])
