"""Near-duplicate detection by circulant MinHash.

Two permutations of the 32-bit integers make every signature: the first scatters
a document's shingles, the second, shifted circularly by k, gives coordinate k.
Bands of coordinates propose links; full shingle sets confirm each of them.

Defined cases: a null or empty text, or one without words, has no shingle and
links with nothing; exact copies (equal sets) form one node before any pairing;
rows that repeat a doc_id are one document that has the links of all its texts,
and each row is returned; a null doc_id gives a null component and is kept; ties
go to the least doc_id; texts of any length count whole; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm import _text
from cadastra.llm._io import Scratch, small_batches
from cadastra.llm.components import connected_components

#: A link at similarity 0.75 shares none of 32 bands of 4 rows in 5 cases of a million.
BANDS, ROWS, WORDS, PERCENT = 32, 4, 5, 75
_V = np.uint32
#: 64-bit words of the bitmap that bounds an intersection from above.
MAP_WORDS = 8
#: So many ids at most (16 MB of longs) are broadcast to pick texts; beyond, the texts are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: The pairs of one document are dealt to so many tasks at most.
SALTS = 128
#: So many documents that propose a shingle are compared in one task; more are dealt to several.
LOT = 1024


def _second(x: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    np.right_shift(x, _V(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)
    np.multiply(x, _V(0x85EBCA6B), out=x)
    np.right_shift(x, _V(13), out=tmp)
    np.bitwise_xor(x, tmp, out=x)
    np.multiply(x, _V(0xC2B2AE35), out=x)
    np.right_shift(x, _V(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)
    return x


def signatures(sets: list[np.ndarray], size: int, block: int = 1 << 15) -> np.ndarray:
    """The circulant MinHash signatures of non-empty sets: coordinate k is the least of pi(sigma(x) + k)."""
    out = np.empty((len(sets), size), np.uint32)
    a = 0
    while a < len(sets):
        b, n = a, 0
        while b < len(sets) and (b == a or n + len(sets[b]) <= block):
            n += len(sets[b])
            b += 1
        first = (_text.mix64(np.concatenate(sets[a:b])) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : b - 1]], dtype=np.int64)]).astype(np.int64)
        shifted, tmp = np.empty_like(first), np.empty_like(first)
        for k in range(size):
            np.add(first, _V(k), out=shifted)
            out[a:b, k] = np.minimum.reduceat(_second(shifted, tmp), at)
        a = b
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, which also names the band."""
    x = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), x.shape[:2]).copy()
    for r in range(rows):
        h = _text.mix64(h * np.uint64(0x9FB21C651E98DF25) + x[:, :, r])
    return h.view(np.int64)


def _describe(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in _text.chunks(batch.column(1)):
                sets = _text.shingle_sets(_text.LOWER[data], off, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                ids: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)):
                        keys[i] = k
                        ids[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "same", "n_shingles", "bands"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in _text.chunks(batch.column(1)):
                sets = [s.view(np.int64) for s in _text.shingle_sets(_text.LOWER[data], off, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def _enough(common: Column, n: Column, m: Column, percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return common * (100 + percent) >= (n + m) * percent


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    1. Describe every document (one pass over the text); equal sets become one node.
    2. In each band bucket, compare the members with the bucket's least member.
    3. Members of a bucket still apart after that may link if enough of their
       shingles also stand in another component. Such a link shares one of the
       rarest of these on both sides (prefix filter), so pairs come from a join on
       those shingles, never from all members of a bucket; bounds on the sizes and
       on a bitmap thin them before the full sets are compared.
    Only links and their endpoints move between executors; texts are read again
    for the documents that have candidates.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = tmp.save(source.mapInArrow(_describe(words, bands, rows), "doc_id long, same binary, n_shingles long, bands array<long>"), "seen")

    linked = seen.where("same is not null and doc_id is not null")
    groups = tmp.save(linked.groupBy("same").agg(F.min("doc_id").alias("id")), "groups")
    nodes = linked.alias("s").join(groups.alias("g"), (F.col("s.same") == F.col("g.same")) & (F.col("s.doc_id") == F.col("g.id")), "left_semi")
    member = nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    heads = member.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")
    member = tmp.save(member.join(heads, "bucket"), "member")

    star = tmp.save(member.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "star")
    first = tmp.save(_confirm(source, star, tmp, "star", words, percent), "first")
    part = tmp.save(connected_components(first, tmp, "one"), "part")

    label = part.withColumnRenamed("component", "own")
    placed = member.select("id", "n", "bucket").join(label, "id", "left").withColumn("own", F.coalesce("own", "id"))
    placed = tmp.save(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    apart = tmp.save(placed.join(mixed.select("bucket"), "bucket", "left_semi").groupBy("id").agg(F.first("own").alias("own")), "apart")
    prefix = tmp.save(_prefix(source, apart, words, percent), "prefix")
    rest = tmp.save(_rest(prefix, percent), "rest")
    second = tmp.save(_confirm(source, rest, tmp, "rest", words, percent), "second")
    both = first.union(second)
    whole = tmp.save(connected_components(both, tmp, "two"), "whole")

    named = groups.join(whole, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    rows_out = seen.select("doc_id", "n_shingles", "same").join(named, "same", "left")
    again = rows_out.groupBy("doc_id").agg(F.min("component").alias("least"), F.count(F.lit(1)).alias("copies"))
    again = again.where("copies > 1 and doc_id is not null").select("doc_id", "least")
    rows_out = rows_out.join(again, "doc_id", "left")
    component = F.coalesce("least", "component", "doc_id")
    out = rows_out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    out = tmp.save(out, "out")
    tmp.drop("seen", "groups", "member", "star", "first", "part", "placed", "apart", "prefix", "rest", "star-ids", "rest-ids", "second", "whole")
    return out


def _needed(source: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The full sets of the named documents, partitioned by id; equal rows count once."""
    named = ids.select(F.col("id").alias("doc_id"))
    if named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    texts = source.join(named, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(words), "id long, shingles array<long>").where(F.size("shingles") > 0)
    same = sets.repartition("id").groupBy("id", F.xxhash64("shingles").alias("same"))
    return same.agg(F.first("shingles").alias("shingles")).drop("same")


def _confirm(source: DataFrame, pairs: DataFrame, tmp: Scratch, name: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; JVM set intersection.

    The pairs of a document with very many are dealt to SALTS tasks, each with a
    copy of its set.
    """
    ids = tmp.save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    sets = _needed(source, ids, words)
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    copies = dealt.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = dealt.join(copies, ["a", "salt"]).select("a", "b", "x")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    n, m = F.size("x").cast("long"), F.size("y").cast("long")
    possible = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    ok = F.when(possible, _enough(F.size(F.array_intersect("x", "y")).cast("long"), n, m, percent)).otherwise(False)
    return both.where(ok).select("a", "b").distinct()


def _prefix(source: DataFrame, apart: DataFrame, words: int, percent: int) -> DataFrame:
    """The documents of apart (id, own) that may link with another component.

    Only shingles that stand in two components can make such a link; e counts
    those of a document, m0 ... are their bitmap. A link shares percent of each
    side's n shingles at least, so of its e it shares one of the e - need + 1
    rarest: the array prefix. Texts that share an id are documents of their own.
    """
    sets = _needed(source, apart, words).withColumns({"n": F.size("shingles").cast("long"), "same": F.xxhash64("shingles")})
    each = sets.join(apart, "id").select("id", "own", "same", "n", F.explode("shingles").alias("h"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("own").alias("least"), F.max("own").alias("most")).where("least < most").select("h", "df")
    word = F.shiftrightunsigned("h", 13).bitwiseAND(F.lit(MAP_WORDS - 1))
    shared = each.join(common, "h").withColumns({"bit": F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 7) & 63 as int))"), "word": word})
    maps = [F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(MAP_WORDS)]
    whole = shared.groupBy("id", "same").agg(F.first("own").alias("own"), F.first("n").alias("n"), F.count(F.lit(1)).alias("e"), *maps, F.sort_array(F.collect_list(F.struct("df", "h"))).alias("all"))
    need = F.ceil(F.col("n") * percent / 100).cast("long")
    prefix = F.transform(F.slice("all", F.lit(1), (F.col("e") - need + 1).cast("int")), lambda x: x["h"])
    return whole.where(F.col("e") >= need).withColumn("prefix", prefix).drop("all", "same")


def _rest(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle of both prefixes and may be links."""
    each = prefix.withColumn("h", F.explode("prefix")).drop("prefix")
    size = each.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    each = each.join(size.select("h", F.ceil(F.col("docs") / LOT).cast("int").alias("lots")), "h")
    columns = ["id", "n", "e", "own", *(f"m{k}" for k in range(MAP_WORDS))]
    x = each.select("h", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int").alias("lot"), *[F.col(c).alias(f"x_{c}") for c in columns])
    y = each.select("h", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), *[F.col(c).alias(f"y_{c}") for c in columns])

    def most(p: str, q: str) -> Column:
        missing = F.lit(0)
        for k in range(MAP_WORDS):
            missing = missing + F.bit_count(F.col(f"{p}_m{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}_m{k}"))))
        return F.col(f"{p}_e") - missing

    n, m = F.col("x_n"), F.col("y_n")
    apart = (F.col("x_own") != F.col("y_own")) & (F.col("x_id") < F.col("y_id"))
    may = _enough(F.least("x_e", "y_e", "x_n", "y_n"), n, m, percent) & _enough(most("x", "y"), n, m, percent) & _enough(most("y", "x"), n, m, percent)
    pairs = x.join(y, (x["h"] == y["h"]) & (x["lot"] == y["lot"]) & apart & may)
    return pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()
