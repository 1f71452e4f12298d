"""Near-duplicates in buckets of one giant group, of repeated ids and of many components."""

import random

import pytest
from pyspark.sql import functions as F

from cadastra.llm import minhash
from tests.llm import brute


def result(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())


@pytest.fixture(scope="module")
def families():
    """Families of texts around 0.75 to each other that share a passage: chains, stars and texts just apart."""
    rng = random.Random(12)
    passage, rows = [f"p{i}" for i in range(60)], []
    for f in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 160))] + passage[: rng.choice((0, 40, 60))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = [f"n{rng.randrange(10**6)}"] * rng.randint(0, 2)
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
            if rng.random() < 0.3:
                base = words
    return rows


def test_families(spark, families):
    want = brute.near_duplicates(families)
    assert result(spark, families) == sorted((i, n, c, i == c) for i, (n, c) in want.items())
    assert 20 < len({c for _, c in want.values()}) < len(families)


def test_links_of_the_rest_need_no_bucket_head(spark, families, monkeypatch):
    """With one band of two rows nearly all texts share a bucket, whose head is none of their kin."""
    head = [(0, " ".join(f"q{i}" for i in range(100)))]
    rows = head + [(i + 1, t) for i, t in families]
    monkeypatch.setattr(minhash, "band_keys", lambda sig, bands, rows: __import__("numpy").zeros((len(sig), 1), "int64"))
    want = brute.near_duplicates(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_a_giant_group_is_dealt_out(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(words)))
    assert {c for _, _, c, _ in result(spark, rows)} == {0}
    pairs = spark.createDataFrame([(0, i) for i in range(1, 1500)], "a long, b long")
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(minhash.SALTS))).groupBy("a", "salt").count().agg(F.max("count")).first()[0]
    assert dealt < 40


def test_repeated_rows_count_once(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text)] * 50 + [(2, text + " x")] * 50 + [(2, "other words that stand alone here")] * 2 + [(3, "other words that stand alone here")]
    got = result(spark, rows)
    assert len(got) == 103 and {c for _, _, c, _ in got} == {1}
    source = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash._needed(source, spark.createDataFrame([(1,), (2,)], "id long"), 5).count() == 3
