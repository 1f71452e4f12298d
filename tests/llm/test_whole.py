"""Operators on input that an earlier short cut left out."""

import re

import pytest

from cadastra.llm.licenses import COMMON, expansions, rules, scan_licenses, triggers


def example(pattern: str) -> str:
    """A text that the pattern matches in full."""
    out = next(x for x in (y.replace("*", "x") for y in expansions(pattern)) if x)
    assert re.fullmatch(pattern, out), (pattern, out)
    return out


def test_expansions_and_triggers_of_all_rules():
    for r in rules():
        every, words = expansions(r.pattern), triggers(r.pattern)
        assert words and all(re.fullmatch(r.pattern, x.replace("*", "free words")) or re.fullmatch(r.pattern, x.replace("*", "word")) for x in every), r
        assert all(words & set(x.split()) for x in every), r
    assert sum(bool(triggers(r.pattern) & COMMON) for r in rules()) <= 6


@pytest.fixture(scope="module")
def labels(spark):
    def of(texts: list[str]) -> list[set[str]]:
        rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        return [set(r.labels.split(",")) for r in sorted(rows, key=lambda r: r.doc_id)]

    return of


def test_each_license_rule_is_found_alone(labels):
    table = rules()
    # "you may not use this file ..." stands in the notices of MPL 1.1 and CDDL too; that rule alone asks for a word outside its pattern.
    away = [r for r in table if r.keyword not in example(r.pattern)]
    assert [(r.label, r.keyword) for r in away] == [("apache-2.0", "apache")]
    got = labels([example(r.pattern) + (f". {r.keyword}" if r in away else "") for r in table])
    assert [r for r, x in zip(table, got) if r.label not in x] == []


def test_license_words_are_matched_not_raw_text(labels):
    texts = {
        "MPL 2.0": "mpl-2.0", "CeCILL 2.1": "cecill-2.1", "Proprietary and confidential": "proprietary", "Unauthorized copying of this file is strictly prohibited.": "proprietary", "for non-commercial use only": "no-commercial",
        "No derivative works permitted": "no-derivatives", "This product includes software developed by the OpenSSL project": "openssl", "Neither the name of X nor the names of its contributors may be used to endorse": "bsd-3-clause",
        "All advertising materials mentioning features or use of this software": "bsd-4-clause", "CC_BY 4.0": "cc-by-4.0", "cc/by": "cc-by", "CC\nBY": "cc-by",
    }
    assert [(t, x) for (t, want), x in zip(texts.items(), labels(list(texts))) if want not in x] == []
    assert labels(["Subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License"]) == [{"mpl-1.1"}]
