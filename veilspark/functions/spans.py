"""Places in texts and folds over arrays, as Column expressions whose cost stays near the size of what they read.

An expression inside of a lambda is evaluated for every element, and appending to an array copies it. So what a
lambda needs is bound first (`let`), running folds work in blocks of the square root of the size (`prefixes`), and
texts are cut by places in an encoding of fixed width (`cut`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks set around matches; texts that hold them are read as if a third one stood there.
MARKS, INSTEAD = "\u0001\u0002", "\u0003\u0003"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _heads(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    none = F.array().cast("array<bigint>")
    return F.aggregate(values, none, lambda a, x: F.array_append(a, step(F.coalesce(F.try_element_at(a, F.lit(-1)), zero), x).cast("bigint")))


def prefixes(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The fold of each head of an array of bigint; `step` must be associative and `zero` neutral."""

    def blocked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        at = F.sequence(F.lit(1), F.size(v), width)
        blocks = F.transform(at, lambda i: _heads(F.slice(v, i, width), zero, step))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = _heads(F.transform(blocks, lambda b: F.element_at(b, -1)), zero, step)
        before = F.concat(F.array(zero), F.slice(totals, 1, F.size(totals) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, t: F.transform(b, lambda x: step(t, x).cast("bigint"))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<bigint>")))


def sums(values: Column) -> Column:
    return prefixes(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """start, end, value of each match of a Java pattern, in code points."""
    parts = F.split(F.regexp_replace(F.translate(text, MARKS, INSTEAD), pattern, "\u0001$0\u0002"), "[\u0001\u0002]")

    def placed(p: Column) -> Column:
        ends = sums(F.transform(p, lambda x: F.length(x).cast("bigint")))
        each = F.zip_with(p, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.filter(each, lambda x, i: i % 2 == 1)

    return let(parts, placed)


def cut(text: Column, places: Column, between: Callable[[Column], Column]) -> Column:
    """The text with between(place) instead of each place; places have start and end, are sorted and don't overlap."""

    def pieces(t: Column, s: Column) -> Column:
        part = lambda a, e: F.decode(F.substring(t, (4 * a + 1).cast("int"), (4 * (e - a)).cast("int")), "UTF-32")
        upto = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(s, lambda x: x["end"].cast("bigint")))
        heads = F.zip_with(F.slice(upto, 1, F.size(s)), s, lambda a, x: F.concat(part(a, x["start"]), between(x)))
        rest = part(F.element_at(upto, -1), F.floor(F.octet_length(t) / 4))
        return F.concat(F.array_join(heads, ""), rest)

    return let(places, lambda s: F.when(F.size(s) > 0, let(F.encode(text, "UTF-32"), lambda t: pieces(t, s))).otherwise(text))


def clusters(spans: Column) -> Column:
    """Spans with start and end, sorted by start, as arrays of those that hang together by overlapping."""
    low = F.lit(-1).cast("bigint")

    def split(s: Column) -> Column:
        reach = prefixes(F.transform(s, lambda x: x["end"].cast("bigint")), low, lambda a, x: F.greatest(a, x))
        return let(reach, lambda r: let(_firsts(s, r), lambda at: _sliced(s, at)))

    return let(spans, lambda s: F.when(F.size(s) > 0, split(s)).otherwise(F.slice(F.array(s), 1, 0)))


def _firsts(s: Column, reach: Column) -> Column:
    """Places, from 1, of spans that begin where all before have ended."""
    starts = F.zip_with(s, F.concat(F.array(F.lit(-1).cast("bigint")), F.slice(reach, 1, F.size(s) - 1)), lambda x, r: x["start"] >= r)
    return F.filter(F.transform(starts, lambda new, i: F.when(new, i + 1)), lambda i: i.isNotNull())


def _sliced(s: Column, at: Column) -> Column:
    upto = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s) + 1))
    return F.zip_with(at, upto, lambda a, b: F.slice(s, a, b - a))
