"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of ASCII letters and digits or other characters above
ASCII. Rolling (Karp-Rabin) hashes of `seed` words join documents and benchmark
items; on each candidate pair the longest common run of unmarked words is marked
as a tile, again and again, until no run of `seed` words is left. An item whose
words are covered by tiles to `percent` or more is found in the document, in
whatever order its parts stand there.

Seeds of an item that together reach fewer words than `percent` asks for can't
make it found by themselves, so the most common ones among the items, up to that
bound, propose no candidate; a common phrase costs nothing where an item has
enough words besides.

Defined cases: null or empty texts, and items without words, match nothing; an
item of fewer words than `seed` needs all of them in a row; repeated documents
are reported one by one; repeated items, and texts that share an item_id, once
with their best coverage (then fewest words, then first text); ties between
tiles take the earliest place in the item, then in the document; a pair with
very many common seeds (one word repeated) is tiled by length, in memory of both
texts; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm import _text
from cadastra.llm._io import Scratch, small_batches

SEED_WORDS, PERCENT, BLOCK_CHARS = 5, 60, 8_000_000
#: A pair of more common places is tiled by length; candidates of a chunk are taken up in groups of about so many.
MOST_PAIRS = 1 << 19
#: Bytes of words: ASCII digits, letters, and all of UTF-8 above ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SCHEMA = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double, tiles string"


def tiles(item: np.ndarray, doc: np.ndarray, pairs: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in item, start in doc, words); pairs are the places (item, doc) of equal runs of k words."""
    order = np.lexsort((pairs[:, 1], pairs[:, 1] - pairs[:, 0]))
    p, t = pairs[order, 0], pairs[order, 1]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(t) != 1) | (np.diff(p) != 1)
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, len(p))) + k - 1
    heap = [(-int(n), int(p[h]), int(t[h])) for h, n in zip(heads, lengths)]
    heapq.heapify(heap)
    used_p, used_t, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = ~(used_p[a : a - n] | used_t[b : b - n])
        if free.all():
            used_p[a : a - n] = used_t[b : b - n] = True
            out.append((a, b, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= k:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return sorted(out)


def _runs(words: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, and whether all of them are free, for each start."""
    total = np.concatenate([[0], np.cumsum(free)])
    return _text.long_windows(words, n), total[n:] - total[: len(total) - n] == n


def tiles_by_length(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The tiles of tiles(), by bisection of the longest common run instead of a list of common places."""
    free_p, free_t, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    most = min(len(item), len(doc))
    while most >= k:
        low, high = k - 1, most  # a common run of low words exists, or low is k - 1
        while low < high:
            n = (low + high + 1) // 2
            (x, x_ok), (y, y_ok) = _runs(item, free_p, n), _runs(doc, free_t, n)
            low, high = (n, high) if np.isin(x[x_ok], y[y_ok]).any() else (low, n - 1)
        if low < k:
            break
        n = most = low
        (x, x_ok), (y, y_ok) = _runs(item, free_p, n), _runs(doc, free_t, n)
        at: dict[int, list[int]] = {}
        for b in np.flatnonzero(y_ok & np.isin(y, x[x_ok])).tolist():
            at.setdefault(int(y[b]), []).append(b)
        ahead = dict.fromkeys(at, 0)
        for a in np.flatnonzero(x_ok).tolist():
            h = int(x[a])
            if h not in at or not free_p[a : a + n].all():
                continue
            while ahead[h] < len(at[h]) and not free_t[at[h][ahead[h]] : at[h][ahead[h]] + n].all():
                ahead[h] += 1  # marked words stay marked
            if ahead[h] < len(at[h]):
                b = at[h][ahead[h]]
                free_p[a : a + n] = free_t[b : b + n] = False
                out.append((a, b, n))
        most = n - 1
    return sorted(out)


class Index:
    """Seed hashes of a block of items: of all their places, and of those that propose candidates."""

    def __init__(self, rows: list[tuple[int, str]], seed: int, percent: int):
        column = pa.array([t for _, t in rows], pa.string())
        self.ids, self.words = [i for i, _ in rows], []
        for _, _, data, off in _text.chunks(column):
            data = _text.LOWER[data]
            starts, ends, at = _text.spans(data, off, WORD)
            h = _text.hashes(data, starts, ends)
            self.words += [h[a:b] for a, b in zip(at[:-1], at[1:])]
        self.seeds: list = [None] * len(self.words)
        self.tables = {}
        for k in sorted({min(seed, len(w)) for w in self.words} - {0}):
            own = [i for i, w in enumerate(self.words) if min(seed, len(w)) == k]
            for i in own:
                h = _text.windows(self.words[i], k)
                order = np.argsort(h, kind="stable")
                self.seeds[i] = h[order], order
            keys, count = np.unique(np.concatenate([self.seeds[i][0] for i in own]), return_counts=True)
            propose = []
            for i in own:
                h, order = self.seeds[i]
                rank = np.empty(len(h), np.int64)  # by place; 0 is the most common seed
                rank[order[np.argsort(-count[np.searchsorted(keys, h)], kind="stable")]] = np.arange(len(h))
                first = np.full(len(self.words[i]), len(h))  # the most common seed that reaches each word
                for j in range(k):
                    first[j : j + len(h)] = np.minimum(first[j : j + len(h)], rank)
                needed = min(max(1, -(-percent * len(first) // 100)), len(first))
                propose.append(np.unique(h[rank[order] >= np.sort(first)[needed - 1]]))
            key, item = np.concatenate(propose), np.repeat(own, [len(x) for x in propose])
            order = np.argsort(key, kind="stable")
            self.tables[k] = keys, key[order], item[order]

    def candidates(self, key: np.ndarray, item: np.ndarray, every: np.ndarray, hit: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(document, its candidate items), a bounded number of proposals at a time."""
        low = np.searchsorted(key, every[hit])
        n = np.searchsorted(key, every[hit], "right") - low
        on = np.flatnonzero(n)
        _, once = np.unique(doc[on].astype(np.uint64) << np.uint64(32) | low[on].astype(np.uint64), return_index=True)
        on = on[once]
        groups = np.flatnonzero(np.diff(doc[on])) + 1
        for group in np.split(on, groups) if len(on) else []:
            found: set[int] = set()
            for a in range(0, len(group), 4096):
                part = group[a : a + 4096]
                for b, c in zip(low[part].tolist(), n[part].tolist()):
                    found.update(item[b : b + c].tolist())
            yield int(doc[group[0]]), np.array(sorted(found))

    def matches(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(document of the chunk, item, tiles) for every pair that may reach the coverage."""
        for k, (keys, key, item) in self.tables.items():
            every = _text.windows(h, k)
            low = np.searchsorted(keys, every)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == every)
            doc = np.searchsorted(at, hit, "right") - 1
            inside = hit + k <= at[doc + 1]
            hit, doc = hit[inside], doc[inside]
            for one, items in self.candidates(key, item, every, hit, doc):
                own = hit[np.searchsorted(doc, one) : np.searchsorted(doc, one, "right")]
                words = h[at[one] : at[one + 1]]
                for which in items.tolist():
                    seeds, order = self.seeds[which]
                    a = np.searchsorted(seeds, every[own])
                    n = np.searchsorted(seeds, every[own], "right") - a
                    if n.sum() > MOST_PAIRS:
                        yield one, which, tiles_by_length(self.words[which], words, k)
                        continue
                    flat = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    yield one, which, tiles(self.words[which], words, np.stack([order[flat], np.repeat(own, n) - at[one]], 1), k)


def _found(block: Index, column: pa.Array, percent: int) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(row, item of the block, covered words, tiles) of the items found, the best one of each item_id."""
    for a, _, data, off in _text.chunks(column):
        data = _text.LOWER[data]
        starts, ends, at = _text.spans(data, off, WORD)
        best: dict[tuple[int, int], tuple] = {}
        for d, i, got in block.matches(_text.hashes(data, starts, ends), at):
            n, covered = len(block.words[i]), sum(x[2] for x in got)
            if got and 100 * covered >= percent * n:
                key, rank = (a + d, block.ids[i]), (-covered / n, n, i)
                if key not in best or rank < best[key][0]:
                    best[key] = rank, covered, got
        for (row, _), (rank, covered, got) in sorted(best.items(), key=lambda kv: kv[0]):
            yield row, rank[2], covered, got


def _search(index, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            out: list[tuple] = []
            for row, i, covered, got in _found(block, batch.column(1), percent):
                n = len(block.words[i])
                out.append((batch.column(0)[row].as_py(), block.ids[i], n, covered, len(got), covered / n, ",".join(f"{x}:{y}:{z}" for x, y, z in got)))
            types = [pa.int64()] * 5 + [pa.float64(), pa.string()]
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _without(index, percent: int, text_at: int):
    """The rows of a batch in which nothing is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for row, *_ in _found(index.value, batch.column(text_at), percent):
                good[row] = False
            yield batch.filter(pa.array(good))

    return run


def _indexes(benchmark: DataFrame, item_col: str, item_text: str, seed: int, percent: int, block_chars: int) -> Iterator[tuple]:
    """(broadcast index, whether it is the last) of each block of items, one at a time on the driver."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null and item_id is not null").distinct()
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own], seed, percent)), k == blocks - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = SEED_WORDS, percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item found in it: SCHEMA; a tile is item start:document start:words.

    Items go to the executors in blocks of about block_chars characters; what a
    block finds is stored before the next one is read, so driver and executors
    hold one block at a time however large the benchmark. Each block is one scan
    of the documents and nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "leaks")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for index, last in _indexes(benchmark, item_col, item_text, seed, percent, block_chars):
        own = source.mapInArrow(_search(index, percent), SCHEMA)
        if not last:
            own = tmp.save(own, f"block-{len(found)}")
            index.destroy()
        found.append(own)
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = SEED_WORDS, percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no benchmark item is found, with all their columns; each row is judged by its own text."""
    spark = docs.sparkSession
    small_batches(spark)
    tmp, left, k = Scratch(spark, "clean"), docs, 0
    for index, last in _indexes(benchmark, item_col, item_text, seed, percent, block_chars):
        left = left.mapInArrow(_without(index, percent, docs.columns.index(text_col)), docs.schema)
        if not last:
            left, k = tmp.save(left, f"left-{k}"), k + 1
            index.destroy()
    return left
