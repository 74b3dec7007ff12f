"""Calendar, cyclic and Fourier column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Year, month, day, hour, weekday (Monday = 0) and day of year."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "weekday": F.weekday(ts),
        "dayofyear": F.dayofyear(ts),
    }


def quarter_of(month: Column) -> Column:
    return F.floor((month - 1) / 3) + 1


def season_of(month: Column) -> Column:
    """1 = Dec-Feb, 2 = Mar-May, 3 = Jun-Aug, 4 = Sep-Nov."""
    return F.floor((month % 12 + 3) / 3)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def month_dummies(month: Column, prefix: str = "m_") -> dict[str, Column]:
    return {f"{prefix}{k}": (month == k).cast("int") for k in range(1, 13)}


def cycle(value: Column, period: float = 12.0, phase: int = 0) -> tuple[Column, Column]:
    """Sine and cosine of the place in the cycle; ``phase=1`` starts the cycle at 1."""
    angle = F.lit(2 * math.pi) * (value - phase) / period
    return F.sin(angle), F.cos(angle)


def fourier_terms(t: Column, orders=(1, 2, 3), period: float = 12.0) -> dict[str, Column]:
    out = {}
    for k in orders:
        angle = F.lit(2 * math.pi * k) * t / period
        out[f"fourier_sin_{k}"] = F.sin(angle)
        out[f"fourier_cos_{k}"] = F.cos(angle)
    return out
