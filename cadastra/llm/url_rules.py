"""URL filter by a sort-merge sweep over reversed-host keys.

A host's key is its labels from last to first, each closed by a dot, so the
hosts below a rule's host are an interval of keys that starts at the rule's own.
Rules and pages are range-sorted together; one pass over the sorted rows of a
part, a batch at a time, keeps a stack of the rules whose intervals are open.
Rules opened in earlier parts are joined to a part through the prefixes of its
first key. Paths and page ids are part of the order, so the pages of one host
spread over parts.

Defined cases: a null url, or one without "://", has empty host and path and no
rule; of the rules that fit, the longest (host and path together, then host)
wins, and of equal rules the first in the list; pages that repeat are judged one
by one; urls of any length are judged whole; an empty table, or one of rules,
gives an empty result or the default verdict; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm._io import Scratch, small_batches
from cadastra.llm._native import lower_ascii


@dataclass(frozen=True)
class UrlRule:
    """Fits host and its subdomains where the path starts with path."""

    host: str
    path: str
    verdict: str


RULES = [UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow")]
_RESULT = "page_id long, host string, path string, rule string, verdict string"
_KEYED = "key string, kind int, path string, page_id long, host string, rule_host string, verdict string, place long"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a url; both empty without "://"."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


@dataclass
class Open:
    """The rules of one key on the stack: (rule host, verdict) by path, and the lengths of the paths, longest first."""

    key: str
    paths: dict[str, tuple[str, str]] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)

    def add(self, path: str, host: str, verdict: str) -> None:
        if path not in self.paths:
            self.paths[path] = host, verdict
            if len(path) not in self.sizes:
                self.sizes = sorted([*self.sizes, len(path)], reverse=True)

    def fit(self, path: str) -> tuple[int, int, str, str] | None:
        """(length of the rule, of its host, rule, verdict) of the longest path that path starts with."""
        for size in self.sizes:
            if size <= len(path) and (got := self.paths.get(path[:size])):
                return len(got[0]) + size, len(got[0]), got[0] + path[:size], got[1]
        return None


def _sweep(default: str):
    """Verdicts of rows in the order of part and key. Kind 0 rows are rules, kind 1 rows pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for part, key, kind, path, page_id, host, rule_host, verdict in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "page_id", "host", "rule_host", "verdict"))):
                if part != at:
                    at, stack = part, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Open(key))
                    stack[-1].add(path, rule_host, verdict)
                    continue
                best = max((f for f in (o.fit(path) for o in stack) if f), key=lambda f: f[:2], default=None)
                out.append((page_id, host, path, best[2] if best else None, best[3] if best else default))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns)], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: list[UrlRule] | DataFrame = RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule (like net/, else null), verdict."""
    spark = pages.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "urls")
    if isinstance(rules, list):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict, k) for k, r in enumerate(rules)], "host string, path string, verdict string, place long")
    rule_rows = rules.select(_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "path", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.col("host").alias("rule_host"), "verdict", "place")
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    page_rows = split.select(_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("verdict"), F.lit(0).cast("long").alias("place"))
    order = ["key", "kind", "path", "page_id"]
    events = rule_rows.unionByName(page_rows).repartitionByRange(*order).sortWithinPartitions(*order)
    events = tmp.save(events.withColumn("part", F.spark_partition_id()), "events")
    first = events.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split(F.col("first"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    open_before = first.select("part", F.explode(prefixes).alias("key")).distinct().join(rule_rows, "key")
    columns = [x.split()[0] for x in _KEYED.split(", ")]
    whole = events.select(*columns, "part").union(open_before.select(*columns, "part"))
    return whole.repartition("part").sortWithinPartitions("part", "key", "kind", "path", "place").mapInArrow(_sweep(default), _RESULT)
