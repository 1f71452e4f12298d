"""String tiling against its definition."""

import random
import re

import numpy as np
import pytest

from cadastra.llm import decontaminate
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def plain_tiles(item, doc, k):
    """Mark the longest common run of unmarked words, the first in the item and then in the document, until none has k words."""
    at = {}
    for b in range(len(doc) - k + 1):
        at.setdefault(tuple(doc[b : b + k]), []).append(b)
    seeds = [(a, b) for a in range(len(item) - k + 1) for b in at.get(tuple(item[a : a + k]), [])]
    used_p, used_t, out = set(), set(), []
    while True:
        best = (k - 1, 0, 0)
        for a, b in seeds:
            n = 0
            while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in used_p and b + n not in used_t:
                n += 1
            if n > best[0]:
                best = (n, a, b)
        n, a, b = best
        if n < k:
            return sorted(out)
        out.append((a, b, n))
        used_p.update(range(a, a + n))
        used_t.update(range(b, b + n))


def test_both_tilings_are_greedy():
    rng = random.Random(1)
    for _ in range(300):
        m, k = rng.choice([1, 2, 3, 5]), rng.choice([1, 2, 3])
        item, doc = (np.array([rng.randrange(m) for _ in range(rng.randint(k, n))], np.uint64) for n in (14, 25))
        pairs = np.array([(p, t) for p in range(len(item) - k + 1) for t in range(len(doc) - k + 1) if (item[p : p + k] == doc[t : t + k]).all()]).reshape(-1, 2)
        want = plain_tiles(item.tolist(), doc.tolist(), k)
        assert (decontaminate.tiles(item, doc, pairs, k) if len(pairs) else []) == want == decontaminate.tiles_by_length(item, doc, k)


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", brute.lower(t))


def brute_leaks(docs, items, k=5, percent=60):
    out = []
    for d, t in docs:
        doc, best = words(t), {}
        for i, x in sorted(set(items)):
            item = words(x)
            got = plain_tiles(item, doc, min(k, len(item))) if item else []
            covered = sum(n for *_, n in got)
            if got and 100 * covered >= percent * len(item) and (i not in best or (covered / len(item), -len(item)) > (best[i][1] / best[i][0], -best[i][0])):
                best[i] = len(item), covered, ",".join(f"{a}:{b}:{n}" for a, b, n in got)
        out += [(d, i, *v) for i, v in best.items()]
    return sorted(out)


def found(spark, docs, items, **options):
    rows = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted((r.doc_id, r.item_id, r.item_words, r.covered_words, r.tiles) for r in rows.collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_leaks([(d, t or "") for d, t in docs], items)
    assert want and found(spark, docs, items) == want == found(spark, docs, items, block_chars=2000)


@pytest.fixture(scope="module")
def hot():
    """Items that share a phrase, short and repeated ones, and documents with parts of them in any order."""
    rng = random.Random(5)
    stem, vocabulary = "which of the following is true of these", [f"v{i}" for i in range(40)]
    items = [(i, f"{stem} " + " ".join(rng.choices(vocabulary, k=rng.randint(3, 30)))) for i in range(60)]
    items += [(70, "two words"), (71, "word " * 40), (72, ""), (73, stem), items[0], (0, "other text of the first item entirely"), (0, items[1][1])]
    docs = []
    for d in range(60):
        parts = [" ".join(x.split()[a : a + rng.randint(3, 20)]) for _, x in rng.choices(items, k=6) for a in [rng.randint(0, 8)]]
        docs.append((d, " ".join(parts + [stem] * rng.randint(0, 5))))
    return docs + [(100, "word " * 5000), (101, "two words"), (102, ""), (103, items[0][1]), (103, items[0][1]), (103, "clean")], items


def test_hot_seeds_and_repeated_items(spark, hot):
    docs, items = hot
    want = brute_leaks([d for d in docs if d[0] != 100], items)
    got = found(spark, docs, items)
    assert [r for r in got if r[0] != 100] == want == [r for r in found(spark, docs, items, block_chars=500) if r[0] != 100]
    assert [r[:4] for r in got if r[0] == 100] == [(100, 71, 40, 40)] and len([r for r in got if r[:2] == (103, 0)]) == 2


def test_the_common_phrase_proposes_only_items_that_it_could_make_found(hot):
    index = decontaminate.Index(sorted(set(hot[1])), 5, 60)
    keys, key, item = index.tables[5]
    common = {k for k, n in zip(*np.unique(np.concatenate([s[0] for s in index.seeds if s is not None]), return_counts=True)) if n > 50}
    proposed = {i for k, i in zip(key, item) if k in common}
    assert common and proposed and all(8 * 100 >= 60 * len(index.words[i]) for i in proposed)


def test_clean_judges_rows(spark, hot):
    docs, items = hot
    df = spark.createDataFrame([(d, t, 1) for d, t in docs + [(None, hot[1][2][1]), (None, None), (104, None)]], "doc_id long, text string, __leak int")
    bad = {r[0] for r in brute_leaks([d for d in docs if d[0] != 100], items)} | {100}
    for options in ({}, {"block_chars": 500}):
        got = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string"), **options)
        assert got.columns == df.columns
        rows = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in got.collect() if r.doc_id != 103 and r.text is not None)
        assert rows == sorted((d, t) for d, t in docs if d not in bad and d != 103)
        assert [r.text for r in got.where("doc_id = 103").collect()] == ["clean"] and got.where("text is null").count() == 2
