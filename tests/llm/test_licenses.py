"""License detections against a plain sweep of all rules, priorities and containments."""

import random
import re

from cadastra.llm.licenses import FAMILIES, NAMES, PASSAGES, SENTENCES, TERMS, rules, scan_licenses
from tests.llm import brute
from tests.llm.test_whole import example


def plain_scan(text):
    """(labels, score, detections) by the definition: every rule, then every pair of detections."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    joined, starts = " " + " ".join(words) + " ", {}
    at = 1
    for k, w in enumerate(words):
        starts[at] = k
        at += len(w) + 1
    hits = set()
    for order, r in enumerate(rules()):
        if f"{r.keyword}" in joined:
            at = 0
            while m := re.compile(f"(?<= )(?:{r.pattern})(?= )").search(joined, at):
                a = starts[m.start()]
                hits.add((a, a + len(m[0].split(" ")), -r.priority, order, r.label, r.weight))
                at = m.end()
    kept = [d for d in hits if not any(e != d and e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and ((e[0], e[1]) != (d[0], d[1]) or (e[2], e[3]) < (d[2], d[3])) for e in hits)]
    base = brute.license_base(text)
    labels = {d[4] for d in kept} | set(filter(None, base[4].split(",")))
    return ",".join(sorted(labels)), max([d[5] for d in kept] + [0.6 if base[1] else 0.0]), len(kept)


def test_priority_and_containment_as_defined(spark):
    rng, table = random.Random(9), rules()
    texts = []
    for _ in range(150):
        parts = [example(r.pattern) for r in rng.choices(table, k=rng.randint(1, 6))]
        parts += rng.choices(["plain words", "version 2", "license", "or later", "the gnu", "gpl v3", "cc by", ""], k=4)
        rng.shuffle(parts)
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts).replace(" by ", rng.choice([" by ", "-BY-"])))
    texts += [None, "", "é" * 50, "mit license " * 2_000]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r.labels, r.score, r.n_detections) == plain_scan(texts[r.doc_id]), texts[r.doc_id][:300]


def test_rules_are_written_by_hand():
    assert len(PASSAGES + SENTENCES + TERMS + NAMES) > 250 and len({r.pattern for r in rules()}) > 450 and len(FAMILIES) > 20
