"""Frequencies, decomposition, wavelets, damped oscillation and mode analysis.

Transforms that need a whole series at once (FFT, filter bank) run per series on
grained panels, whose length the calendar bounds; everything else is grouped sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import gram
from tidewell.panel import BY, over, with_position

# The eight scaling-filter taps of the Daubechies wavelet with four vanishing moments.
DB4 = (
    0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
    -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
)
CWT_SCALES = (1, 2, 4, 8, 16)
RICKER_REACH = 8


def top_frequencies(df: DataFrame, k: int = 3, y="y") -> DataFrame:
    """The k strongest non-zero frequencies of each demeaned series; ties go to the lower one."""

    def strongest(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("ts")["y"].to_numpy(float)
        n = len(v)
        amp = np.abs(np.fft.rfft(v - v.mean()))[1:]
        order = np.lexsort((np.arange(len(amp)), -np.round(amp, 4)))[:k]
        return pd.DataFrame(
            {"series_id": pdf["series_id"].iloc[0], "rank": np.arange(1, len(order) + 1), "omega": 2 * np.pi * (order + 1) / n, "amplitude": amp[order]}
        )

    narrow = df.select("series_id", "ts", F.col(y).alias("y")).where(F.col(y).isNotNull())
    return narrow.groupBy("series_id").applyInPandas(strongest, "series_id string, rank int, omega double, amplitude double")


def decompose(df: DataFrame, y="y", period: int = 12, by=BY, order=("ts",)) -> DataFrame:
    """Classical additive split: centred moving average, phase means around zero, rest."""
    half = period // 2
    w = over(by, order)
    frame = w.rowsBetween(-half, half)
    ends = F.lag(y, half).over(w) + F.lead(y, half).over(w)
    total = F.sum(y).over(frame)
    trend = (total - ends / 2) / period if period % 2 == 0 else total / period
    out = with_position(df, by, order).withColumn("trend", F.when(F.count(y).over(frame) == 2 * half + 1, trend))
    out = out.withColumns({"_phase": F.col("t") % period, "_d": F.col(y) - F.col("trend")})
    raw = out.withColumn("_s", F.avg("_d").over(Window.partitionBy(*by, "_phase")))
    # mean over phases, each phase once
    first = F.row_number().over(Window.partitionBy(*by, "_phase").orderBy("t")) == 1
    level = F.avg(F.when(F.col("_one"), F.col("_s"))).over(Window.partitionBy(*by))
    raw = raw.withColumn("_one", first)
    return (
        raw.withColumn("seasonal", F.col("_s") - level)
        .withColumn("resid", F.col("_d") - F.col("seasonal"))
        .drop("_phase", "_d", "_s", "_one")
    )


def _filter_bank(v: np.ndarray, levels: int) -> list[tuple[str, float]]:
    low = np.array(DB4)
    high = low[::-1] * np.where(np.arange(8) % 2 == 0, 1.0, -1.0)
    out = []
    for level in range(1, levels + 1):
        if len(v) % 2:
            v = np.append(v, v[-1])
        idx = (2 * np.arange(len(v) // 2)[:, None] + np.arange(8)) % len(v)
        detail, v = v[idx] @ high, v[idx] @ low
        out.append((f"d{level}", float(np.mean(detail**2))))
    return out + [(f"a{levels}", float(np.mean(v**2)))]


def wavelet_energies(df: DataFrame, y="y") -> DataFrame:
    """Mean squared coefficient per level of a periodic filter bank."""

    def energies(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("ts")["y"].to_numpy(float)
        levels = max(int(math.floor(math.log2(max(len(v), 1) / 7))), 0) if len(v) >= 14 else 0
        rows = _filter_bank(v, levels) if levels else []
        names = np.full(len(rows), pdf["series_id"].iloc[0], dtype=object)
        return pd.DataFrame({"series_id": names, "level": np.array([r[0] for r in rows], dtype=object), "energy": np.array([r[1] for r in rows], float)})

    narrow = df.select("series_id", "ts", F.col(y).alias("y")).where(F.col(y).isNotNull())
    return narrow.groupBy("series_id").applyInPandas(energies, "series_id string, level string, energy double")


def ricker_energies(df: DataFrame, y="y", scales: Sequence[int] = CWT_SCALES) -> DataFrame:
    """Mean squared coefficient per scale of a continuous transform with the Ricker wavelet."""
    c = 2 / (math.sqrt(3) * math.pi**0.25)

    def energies(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("ts")["y"].to_numpy(float)
        rows = []
        for s in scales:
            x = np.arange(-RICKER_REACH * s, RICKER_REACH * s + 1) / s
            kernel = c * (1 - x**2) * np.exp(-(x**2) / 2) / math.sqrt(s)
            full = np.convolve(v, kernel)
            coef = full[RICKER_REACH * s : RICKER_REACH * s + len(v)]
            rows.append(float(np.mean(coef**2)))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "scale": list(scales), "energy": rows})

    narrow = df.select("series_id", "ts", F.col(y).alias("y")).where(F.col(y).isNotNull())
    return narrow.groupBy("series_id").applyInPandas(energies, "series_id string, scale int, energy double")


def fit_damped(df: DataFrame, y="y", modes: int = 2, period: int = 12, decays: Sequence[float] = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1), by=BY, order=("ts",)) -> DataFrame:
    """Damped cosine sum with fixed frequencies 2 pi (m+1)/period.

    Every decay combination is one least-squares problem in cosine and sine
    terms; one aggregation sums the products of all of them, no row is copied,
    and the combination with the lowest error is kept.  Returns (series_id, mean, sse, params).
    """
    rows = with_position(df.where(F.col(y).isNotNull()), by, order)
    rows = rows.withColumn("mean", F.avg(y).over(Window.partitionBy(*by)))
    # a cosine and a sine per mode and decay; every combination of decays is a part of their sums
    xs, place = [], {}
    for m in range(modes):
        angle = F.lit(2 * math.pi * (m + 1) / period) * F.col("t")
        for d in decays:
            damp = F.exp(F.lit(-float(d)) * F.col("t"))
            place[m, d] = len(xs)
            xs += [damp * F.cos(angle), damp * F.sin(angle)]
    sums = gram.gram_sums(rows, [*by, "mean"], xs, F.col(y) - F.col("mean"))
    grid = [[]]
    for _ in range(modes):
        grid = [g + [float(d)] for g in grid for d in decays]
    cells = [F.struct(F.array(*[F.lit(d) for d in g]).alias("decay"), F.array(*[F.lit(place[m, d] + i) for m, d in enumerate(g) for i in (0, 1)]).alias("_at")) for g in grid]
    each = sums.select(*by, "mean", "yy", F.col("xtx").alias("_all"), F.col("xty").alias("_any"), F.inline(F.array(*cells)))
    part = F.flatten(F.transform("_at", lambda i: F.transform("_at", lambda j: F.get("_all", i * len(xs) + j))))
    fitted = gram.solve(each.withColumns({"xtx": part, "xty": F.transform("_at", lambda i: F.get("_any", i))}))
    err = gram.sse(F.col("beta"), F.col("xtx"), F.col("xty"), F.col("yy"), 2 * modes)
    best = (
        fitted.withColumn("sse", F.greatest(err, F.lit(0.0)))
        .groupBy(*by, "mean")
        .agg(F.min_by(F.struct("decay", "beta", "sse"), F.struct(F.round("sse", 3), "decay")).alias("b"))
    )
    params = F.array(
        *[
            F.struct(
                F.hypot(F.col("b.beta")[2 * m], F.col("b.beta")[2 * m + 1]).alias("amplitude"),
                F.col("b.decay")[m].alias("decay"),
                F.lit(2 * math.pi * (m + 1) / period).alias("omega"),
                (-F.atan2(F.col("b.beta")[2 * m + 1], F.col("b.beta")[2 * m])).alias("phase"),
            )
            for m in range(modes)
        ]
    )
    return best.select(*by, "mean", F.col("b.sse").alias("sse"), params.alias("params"))


def koopman_modes(df: DataFrame, y="y", lag: int = 3, by=BY, order=("ts",)) -> DataFrame:
    """Extended mode decomposition of lagged states.

    Observables are 1, x, x^2, sin x, cos x per lag on the standardised series.
    The two moment matrices are grouped sums; eigenvalues come from the
    aggregated row.  Returns (series_id, mode, re, im, modulus, omega, coord_re,
    coord_im) with the coordinates of the last state.
    """
    whole = Window.partitionBy(*by)
    z = (F.col(y) - F.avg(y).over(whole)) / F.nullif(F.stddev_pop(y).over(whole), F.lit(0.0))
    rows = df.where(F.col(y).isNotNull()).withColumn("_z", F.coalesce(z, F.lit(0.0)))
    w = over(by, order)
    lagged = rows.withColumns({f"_l{i}": F.lag("_z", i).over(w) for i in range(lag)})

    def observables(prefix):
        out = [F.lit(1.0)]
        for i in range(lag):
            x = F.col(f"{prefix}{i}")
            out += [x, x * x, F.sin(x), F.cos(x)]
        return out

    d = 1 + 4 * lag
    states = lagged.where(F.col(f"_l{lag - 1}").isNotNull()).withColumn("_g", F.array(*observables("_l")))
    pairs = states.withColumn("_h", F.lead("_g").over(w))
    sums = pairs.groupBy(*by).agg(
        F.max_by("_g", F.struct(*order)).alias("last"),
        F.array(*[F.sum(F.when(F.col("_h").isNotNull(), F.col("_g")[i] * F.col("_g")[j])) for i in range(d) for j in range(i, d)]).alias("g0"),
        F.array(*[F.sum(F.col("_h")[i] * F.col("_g")[j]) for i in range(d) for j in range(d)]).alias("g1"),
    )

    def modes(batches):
        upper = np.triu_indices(d)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.g0 is None or pd.isna(r.g0[0]):  # no state has a successor
                    continue
                a = np.zeros((d, d))
                a[upper] = np.asarray(r.g0, float)
                a = a + a.T - np.diag(np.diag(a))
                k = np.asarray(r.g1, float).reshape(d, d) @ np.linalg.pinv(a, hermitian=True)
                values, vectors = np.linalg.eig(k)
                coords = np.linalg.pinv(vectors) @ np.asarray(r.last, float)
                rank = np.lexsort((-values.imag, -np.round(np.abs(values), 9)))
                values, coords = values[rank], coords[rank]
                yield pd.DataFrame(
                    {
                        **{b: getattr(r, b) for b in by},
                        "mode": np.arange(1, d + 1),
                        "re": values.real,
                        "im": values.imag,
                        "modulus": np.abs(values),
                        "omega": np.angle(values),
                        "coord_re": coords.real,
                        "coord_im": coords.imag,
                    }
                )

    keys = ", ".join(f"{b} string" for b in by)
    return sums.mapInPandas(modes, f"{keys}, mode int, re double, im double, modulus double, omega double, coord_re double, coord_im double")
