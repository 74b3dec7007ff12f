"""Query registry: Spark callables with, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Exact decimals such as x.xxxx5 would round by the last bit of a sum, which
# differs between engines; a border off the decimal grid avoids those ties.
HALF = 0.50037


def q(col: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, for comparison across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c.cast("double") * float(10**digits) + HALF) / float(10**digits)


def sq(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``q``."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits} + {HALF}) / 1e{digits})"


def day(col: Column | str) -> Column:
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd")


def sday(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


# --- SQL twins of the distribution functions, for oracles ---------------------------


def _poly_sql(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def normal_cdf_sql(x: str) -> str:
    """``x`` must be a plain column name."""
    from tidewell.functions import distribution as d

    z = f"abs({x})"
    far = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))))"
    near = f"(exp(-{z} * {z} / 2) * {_poly_sql(d.TAIL_NUM, z)} / {_poly_sql(d.TAIL_DEN, z)})"
    tail = f"(CASE WHEN {z} > 37 THEN 0 WHEN {z} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_quantile_sql(p: str) -> str:
    """``p`` must be a plain column name."""
    from tidewell.functions import distribution as d

    e = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    tail = f"({_poly_sql(d.INV_C, e)} / {_poly_sql(d.INV_D, e)})"
    c = f"({p} - 0.5)"
    centre = f"({c} * {_poly_sql(d.INV_A, f'({c} * {c})')} / {_poly_sql(d.INV_B, f'({c} * {c})')})"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 1 - 0.02425 THEN -{tail} ELSE {centre} END)"


def uniform_sql(seed: int, *keys: str) -> str:
    """The SQL twin of ``draws.portable_uniform``."""
    joined = ", ".join(["'" + str(seed) + "'", *keys])
    return f"((('0x' || substr(md5(concat_ws('|', {joined})), 1, 12))::BIGINT + 0.5) / {float(1 << 48)!r}::DOUBLE)"


def poisson_sql(u: str) -> str:
    import math

    terms, cum = [], 0.0
    for k in range(0, 12):
        cum += math.exp(-1) / math.factorial(k)
        terms.append(f"({u} > {cum!r}::DOUBLE)::INT")
    return "(" + " + ".join(terms) + ")"
