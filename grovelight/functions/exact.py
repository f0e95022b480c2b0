"""Sums of doubles that don't depend on the order of rows.

Each value is scaled by a power of two near its own size and cut into three integers of 32, 27 and 26 bits. Integers add
up exactly in any order, so partial sums may be merged anyhow; at the end the few totals, one set a power of two that
occurs, are put together by compensated addition from small to large. Groups may have 2**31 rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, LEAST, MOST = 30, -36, 34
#: Squared, the scale of each slot; two factors, as one could overflow.
_ROOTS = [2.0 ** (-STEP // 2 * q) for q in range(LEAST, MOST + 1)]


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def slot(x: Column) -> Column:
    """Which power of two scales ``x``; zero, missing and non-finite values share slot 0."""
    q = F.floor(F.log2(F.abs(x)) / STEP).cast("int")
    return F.when(_finite(x) & (x != 0), F.greatest(F.lit(LEAST), F.least(F.lit(MOST), q))).otherwise(F.lit(0))


def total_parts(x: Column, q: Column) -> Column:
    """Aggregate: totals of the values of one slot. Group by ``slot(x)`` as well."""
    root = F.get(F.array(*map(F.lit, _ROOTS)), q - LEAST)
    y = F.when(_finite(x), x * root * root)
    high = F.floor(y)
    rest = (y - high) * float(1 << 27)
    middle = F.floor(rest)
    low = (rest - middle) * float(1 << 26)
    whole = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    odd = F.sum(F.when(~_finite(x), x))
    return F.struct(q.alias("q"), whole(high).alias("high"), whole(middle).alias("middle"), whole(low).alias("low"), odd.alias("odd"), F.count(x).alias("n"))


def _pieces(p: Column) -> Column:
    """A slot's total as doubles, each without a rounding."""
    unit = F.get(F.array(*[F.lit(1 / r) for r in _ROOTS]), p["q"] - LEAST)
    top = F.shiftright(p["high"], 31)
    return F.transform(F.array(p["low"] / float(1 << 53), p["middle"] / float(1 << 27), (p["high"] - F.shiftleft(top, 31)).cast("double"), top * float(1 << 31)), lambda v: v * unit * unit)


def total(parts: Column) -> Column:
    """The sum from the list of a group's ``total_parts``; null if no value is there."""
    values = F.array_sort(F.flatten(F.transform(parts, _pieces)), lambda a, b: F.when(F.abs(a) < F.abs(b), -1).when(F.abs(a) > F.abs(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))

    def add(acc: Column, v: Column) -> Column:
        t = acc["s"] + v
        lost = F.when(F.abs(acc["s"]) >= F.abs(v), (acc["s"] - t) + v).otherwise((v - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    summed = F.aggregate(values, zero, add, lambda a: a["s"] + a["c"])
    odd = F.filter(F.transform(parts, lambda p: p["odd"]), lambda v: v.isNotNull())
    strange = F.aggregate(odd, F.lit(0.0), lambda a, v: a + v)
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    return F.when(n > 0, F.when(F.size(odd) > 0, strange).otherwise(summed))
