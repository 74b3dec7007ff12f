"""Column expressions over windows held as ARRAY<DOUBLE>."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def constant(values, kind: str) -> Column:
    """Numbers in (nested) lists as one constant of the plan, however many there are."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value worked out once: a column named in a lambda is worked out for every element."""
    return F.transform(F.array(value), use)[0]


def std(a: Column, ddof: int = 0) -> Column:
    ss = _held(mean(a), lambda m: F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x))
    return F.sqrt(ss / F.nullif(F.size(a) - ddof, F.lit(0)))


def z_norm(a: Column) -> Column:
    """Centre and divide by the population deviation; a flat window is only centred."""
    return _held(mean(a), lambda m: _held(std(a), lambda s: F.transform(a, lambda x: (x - m) / F.when(s > 0, s).otherwise(1.0))))


def euclid(a: Column, b: Column) -> Column:
    d2 = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d2, F.lit(0.0), lambda s, x: s + x))


def envelope(a: Column, radius: int) -> tuple[Column, Column]:
    """Running min and max of ``a`` within ``radius`` positions."""

    def around(i: Column) -> Column:
        start = F.greatest(i - radius, F.lit(1))
        return F.slice(a, start, F.least(i + radius, F.size(a)) - start + 1)

    places = F.sequence(F.lit(1), F.size(a))
    return F.transform(places, lambda i: F.array_min(around(i))), F.transform(places, lambda i: F.array_max(around(i)))


def lb_keogh(query: Column, low: Column, high: Column) -> Column:
    """Lower bound of the banded warping distance, from a candidate's envelope."""
    bounds = F.zip_with(low, high, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    gap = F.zip_with(query, bounds, lambda x, b: F.greatest(x - b["hi"], b["lo"] - x, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g))


def dtw(a: Column, b: Column, band: int | None = None) -> Column:
    """Dynamic time warping, squared cost, root of the total.

    One array per table row of the recurrence, so the memory is one row of
    length ``size(b) + 1``.  ``band`` is the largest index difference allowed.
    """
    inf = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(inf, F.size(b)))
    reach = F.lit(band) if band is not None else F.greatest(F.size(a), F.size(b))

    def next_row(prev: Column, i: Column) -> Column:
        def cell(cur: Column, j: Column) -> Column:
            d = F.element_at(a, i) - F.element_at(b, j)
            best = F.least(F.element_at(prev, j + 1), F.element_at(prev, j), F.element_at(cur, -1))
            return F.concat(cur, F.array(F.when(F.abs(i - j) <= reach, d * d + best).otherwise(inf)))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(inf), cell)

    last = F.aggregate(F.sequence(F.lit(1), F.size(a)), first, next_row)
    return F.sqrt(F.element_at(last, -1))
