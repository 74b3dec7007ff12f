"""Random columns from row keys: the same value on every retry and every machine."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.distribution import normal_quantile

STEPS = 1 << 40


def uniform(seed: int, keys: Sequence[str | Column]) -> Column:
    """Uniform in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(STEPS)) + 0.5) / float(STEPS)


def portable_uniform(seed: int, keys: Sequence[str | Column]) -> Column:
    """The same from MD5 of the joined keys: slower, but any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


Draw = Callable[[int, Sequence[str | Column]], Column]


def gaussian(seed: int, keys: Sequence[str | Column], draw: Draw = uniform) -> Column:
    return normal_quantile(draw(seed, keys))


def poisson_one(seed: int, keys: Sequence[str | Column], draw: Draw = uniform) -> Column:
    """Poisson(1) count by inverse distribution function: a bootstrap weight."""
    u = draw(seed, keys)
    out, cum = F.lit(0), 0.0
    for k in range(0, 12):
        cum += math.exp(-1) / math.factorial(k)
        out = out + (u > cum).cast("int")
    return out
