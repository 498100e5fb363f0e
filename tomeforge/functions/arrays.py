"""Column expressions over long arrays of a row, in time near linear in their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_value(value: Column, use) -> Column:
    """use(value) with value computed once a row, also where ``use`` names it inside lambdas."""
    return F.transform(F.array(value), use)[0]


#: Values of an array that are taken together by ``running``.
TOGETHER = 128


def in_parts(values: Column) -> Column:
    """An array cut into arrays of ``TOGETHER`` values, the last one shorter."""
    at = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / TOGETHER).cast("int"))
    parts = F.transform(at, lambda i: F.slice(values, i * TOGETHER + 1, TOGETHER))
    return F.when(F.size(values) > 0, parts).otherwise(F.slice(F.array(values), 1, 0))


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """Running sums of an array of ints, or running values of another associative ``join``.

    An array that grows by one value copies itself each time. So parts are scanned each for
    itself, and then their ends: the time is near linear in arrays of millions.
    """
    last = lambda a: F.get(a, F.size(a) - 1)
    add = lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, join(last(a), x)).otherwise(x)))
    scan = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), add)

    def carried(parts: Column) -> Column:
        ends = scan(F.transform(parts, last))
        on = lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: F.when(i > 0, join(F.get(e, i - 1), x)).otherwise(x))))
        return with_value(ends, on)

    return with_value(F.transform(in_parts(values), scan), carried)


def pieces(text: Column, spans: Column) -> Column:
    """The parts of a text that ``spans`` (start, length) name, in code points, sorted by start.

    Finding a place in a text takes time in proportion to it, so a part of the spans is looked up in its part of the text.
    """

    def of(part: Column) -> Column:
        first, last = F.get(part, 0)["start"], F.get(part, F.size(part) - 1)
        cut = lambda body: F.transform(part, lambda s: F.substring(body, s["start"] - first + 1, s["length"]))
        return with_value(F.substring(text, first + 1, last["start"] + last["length"] - first), cut)

    return F.flatten(F.transform(in_parts(spans), of))
