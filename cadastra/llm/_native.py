"""Column expressions over text that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks the edges of matches; texts that hold it get the other private character in its place, as no pattern tells them apart.
_MARK, _OTHER = "\ue000", "\ue001"
BLOCK = 128
_SPAN = "struct<at:int,to:int,part:string>"
NO_SPANS = f"cast(array() as array<{_SPAN}>)"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def unused(df: DataFrame) -> str:
    """A prefix that no column of df starts with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column], block: int = BLOCK) -> Column:
    """For an array of ints, what op makes of 0 and all entries before each one (op is associative, 0 its identity).

    Entries are folded by blocks: an accumulator is copied at every step, so one
    that grows with a text's matches would cost their square.
    """

    def whole(v: Column) -> Column:
        n = F.size(v)
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / block).cast("int"))
        inside = lambda k: F.sequence(k * block, F.least(k * block + block, n) - 1)
        own = F.transform(blocks, lambda k: F.aggregate(inside(k), F.lit(0), lambda a, i: op(a, F.element_at(v, i + 1))))
        begin = F.array(F.lit(0))
        grow = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
        each = bound(F.aggregate(own, begin, grow), lambda at: F.transform(blocks, lambda k: F.slice(F.aggregate(inside(k), F.array(F.element_at(at, k + 1)), lambda acc, i: grow(acc, F.element_at(v, i + 1))), 1, block)))
        return F.when(n == 0, F.expr("cast(array() as array<int>)")).otherwise(F.slice(F.flatten(each), F.lit(1), n))

    return bound(values, whole)


def places(text: Column, pattern: Column, group: int = 0, measure: Callable[[Column], Column] = F.length) -> Column:
    """Leftmost non-overlapping matches: array of (at, to, part), in units of measure; part is the group.

    One replacement puts marks around the matches and one split cuts the text
    there; the sizes of the pieces give the places, as Spark has no function for
    the places of all matches.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, F.lit(f"{_MARK}$0{_MARK}${group}{_MARK}"))

    def placed(cells: Column) -> Column:
        index = F.sequence(F.lit(0), F.floor(F.size(cells) / 3).cast("int") - 1)
        sizes = F.transform(index, lambda k: F.struct(measure(F.element_at(cells, k * 3 + 1)).alias("gap"), measure(F.element_at(cells, k * 3 + 2)).alias("own"), F.element_at(cells, k * 3 + 3).alias("part")))
        every = bound(sizes, lambda z: F.zip_with(z, running(F.transform(z, lambda x: x["gap"] + x["own"]), lambda a, b: a + b), lambda x, at: F.struct((at + x["gap"]).alias("at"), (at + x["gap"] + x["own"]).alias("to"), x["part"].alias("part"))))
        return F.when(F.size(cells) < 3, F.expr(NO_SPANS)).otherwise(every)

    return bound(F.split(marked, _MARK, -1), placed)


def cut_out(text: Column, spans: Column, mark: str, width: int = 4096) -> Column:
    """text with each (at, to) of spans, sorted by start, replaced by mark; spans that overlap an earlier one are part of it.

    The text is cut into blocks of width characters first: finding a place in a
    string costs a scan from its start.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    size = F.length(text)

    def pieces(cells: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / width).cast("int"), F.floor((b - 1) / width).cast("int")
            part = lambda k: F.substring(F.element_at(cells, k + 1), F.greatest(a - k * width, F.lit(0)) + 1, F.least(b - k * width, F.lit(width)) - F.greatest(a - k * width, F.lit(0)))
            return F.when(b > a, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise(F.lit(""))

        gaps = F.filter(F.zip_with(running(F.transform(spans, lambda s: s["to"]), F.greatest), spans, lambda last, s: F.struct(last.alias("a"), s["at"].alias("b"))), lambda g: g["b"] >= g["a"])
        end = F.aggregate(spans, F.lit(0), lambda acc, s: F.greatest(acc, s["to"]))
        return F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(piece(g["a"], g["b"]), F.lit(mark))), ""), piece(end, size))

    return bound(blocks, pieces)
