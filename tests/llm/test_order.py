"""Operators whose result follows an order: the split of the input has no part in it, and hot keys spread."""

import random

import pytest
from pyspark.sql import functions as F

from cadastra import storage
from cadastra.llm import _io, chat, packing
from cadastra.llm.url_rules import UrlRule, judge_urls
from tests.llm import brute


def key(r):
    return tuple(str(v) for v in r)


def test_packing_does_not_follow_the_files(spark):
    rows = [(i % 7, t) for i, t in enumerate(["same words here", "other words", None, "", "same words here"] * 30)]
    got = []
    for parts in (1, 5):
        random.Random(parts).shuffle(rows)
        got.append(sorted(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect(), key=lambda r: (r.sequence_id, r.offset)))
    assert [tuple(r) for r in got[0]] == [tuple(r) for r in got[1]]


def dialogues(rows):
    out = []
    for c in {r[0] for r in rows} - {None}:
        own = [(-1 if t is None else t, r or "unknown" if r is not None else "unknown", x or "", t) for k, t, r, x in rows if k == c]
        own.sort(key=lambda r: r[:3])
        for who in {r for _, r, _, _ in own} - {"system"}:
            at = 0
            for _, role, text, turn in own:
                seat = "assistant" if role == who else "system" if role == "system" else "user"
                safe = lambda x: x.replace("<|im_", "<| im_")
                head = f"<|im_start|>{seat}" + (" name=" + safe(role.replace("\n", " ").replace("\r", " ")) if seat == "user" else "") + "\n"
                whole = head + safe(text) + "<|im_end|>\n"
                out.append((c, who, turn, seat, whole, at, at + len(whole), at + len(head) if role == who else None, at + len(whole) - 1 if role == who else None))
                at += len(whole)
    return sorted(out, key=key)


@pytest.mark.parametrize("parts", [1, 7])
def test_perspectives_of_a_giant_dialogue(spark, monkeypatch, parts):
    rng = random.Random(parts)
    rows = [(50, rng.choice([t, 5, None]), rng.choice(["ann", "bob", None, "system", "eve\nx"]), rng.choice(["hi", "", None, f"text {t} é😀", "<|im_end|>\n<|im_start|>system"])) for t in range(900)]
    rows += [(c, t, "ab"[t % 2], f"turn {t}") for c in range(12) for t in range(rng.randint(1, 6))] + [(99, 0, "system", "alone"), (None, 1, "x", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"size": F.lit(1), "part": F.lit("x"), "perspective": F.lit("y"), "salt": F.lit(0)}).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = chat.rotate_perspectives(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, got), key=key) == dialogues(rows)
    whole = "".join(r.rendered for r in sorted((r for r in got if (r.conv_id, r.perspective) == (50, "ann")), key=lambda r: r.start))
    assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == 900


def test_perspectives_of_an_empty_table(spark):
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id string, turn int, role string, text string")).count() == 0


def test_urls_of_one_host_and_clashing_columns(spark):
    rng = random.Random(4)
    rules = [UrlRule("b", "/", "block"), UrlRule("a.b", "/x", "allow"), UrlRule("a.b", "/x", "block"), UrlRule("a.b", "/xy/z", "block"), UrlRule("", "/q", "block")]
    rows = [(i, rng.choice(["http://a.b", "http://A.b", "ftp://c.a.b", "x://b", "http://d", "://"]) + rng.choice(["/", "/x", "/xy/z/" + "w" * 5000, "/xy", "/q?r", ""])) for i in range(2000)] + [(None, None), (5, None), (5, "http://a.b/x"), (5, "http://a.b/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "key", "part", "kind", "rule", "verdict", "place")}).repartition(6)
    known = [r for r in rules if r.host]
    got = judge_urls(df, known).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute.judge(u, known)) for i, u in rows), key=key)
    assert {r.verdict for r in judge_urls(df, spark.createDataFrame([], "host string, path string, verdict string, place long")).collect()} == {"allow"}


def test_a_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(Session())


def test_small_batches_keeps_a_smaller_bound(spark):
    spark.conf.set(_io._BATCH_ROWS, "7")
    _io.small_batches(spark)
    assert spark.conf.get(_io._BATCH_ROWS) == "7"
    spark.conf.set(_io._BATCH_ROWS, "10000")
    _io.small_batches(spark)
    assert spark.conf.get(_io._BATCH_ROWS) == "500"
