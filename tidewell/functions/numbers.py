"""Lenient number parsing and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def to_number(value: Column) -> Column:
    """Double or NULL, never an error; NaN counts as missing."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def to_time(value: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(value, F.lit(fmt)) if fmt else F.try_to_timestamp(value)


def _first_number(text: Column) -> Column:
    """First signed decimal in a text, brackets, quotes, percent signs and commas read as blanks."""
    found = F.regexp_extract(F.regexp_replace(text, r"[{}()\[\]\"'%,]", " "), NUMBER, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def extract_number(text: Column) -> Column:
    """A number from messy text.

    Lists and objects in JSON give their first element that holds a number;
    any other text gives its first signed decimal, exponent included.
    """
    text = F.trim(text)
    items = F.coalesce(F.map_values(F.from_json(text, "map<string,string>")), F.from_json(text, "array<string>"))
    numbers = F.filter(F.transform(items, lambda s: F.coalesce(s.try_cast("double"), _first_number(s))), lambda v: v.isNotNull())
    from_json = F.when(text.rlike(r"^[\[{]"), F.try_element_at(numbers, F.lit(1)))
    return F.coalesce(text.try_cast("double"), from_json, _first_number(text))


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b; a zero or missing denominator gives ``default``."""
    out = a / F.nullif(b, F.lit(0.0))
    return out if default is None else F.coalesce(out, F.lit(default))


def correlation(a: Column | str, b: Column | str, frame: WindowSpec | None = None) -> Column:
    """Correlation of complete pairs, NULL where one side does not vary.

    The built-in one divides by zero there, which is an error in ANSI mode.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if frame is not None:
        parts = [p.over(frame) for p in parts]
    return parts[0] / F.nullif(parts[1], F.lit(0.0)) / F.nullif(parts[2], F.lit(0.0))


def finite_or(value: Column, default: float) -> Column:
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))
