"""Exact order statistics and distribution comparisons without collecting a group.

Values fall into fixed, order-preserving logarithmic bins; bin counts (combined map-side,
bounded by the number of bins) locate the wanted ranks, and only the values of the few bins
that hold them are ranked, after a bin with too many rows was cut into narrower parts.  Values
that are costly to make are written once to the shared folder; a plain scan is read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import scratch_path

BINS_PER_OCTAVE = 4096
#: Rows of a wanted bin that one task ranks, and parts into which a larger one is cut.
MOST_IN_BIN, PARTS = 100_000, 4096


def value_bin(v: Column) -> Column:
    """Integer that grows with ``v``; about 0.02 % of the value wide."""
    size = F.floor(F.log2(F.abs(v)) * BINS_PER_OCTAVE) + 1100 * BINS_PER_OCTAVE
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _plain(df: DataFrame) -> bool:
    """Is this a scan with projections and filters only?  Then reading it twice is cheaper than writing it."""
    nodes = [line.lstrip(" :+-").split("[")[0].split("(")[0].split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip()]
    return all(n in ("Project", "Filter", "Relation", "Generate", "LogicalRDD") for n in nodes) and "pythonUDF" not in df._jdf.queryExecution().optimizedPlan().toString()


def order_stats(df: DataFrame, value: Column | str, ranks: Mapping[str, Callable[[Column], Column]], by: Sequence[str] = (), most_in_bin: int = MOST_IN_BIN) -> DataFrame:
    """Values at fractional 0-based ranks, linearly interpolated: (by..., label, value, n).

    ``ranks`` maps a label to a function from the group size to the rank.  A wanted bin of more
    than ``most_in_bin`` rows is cut into equal parts of its own range, again and again, until
    the part with the wanted rank is small enough or holds one value.
    """
    spark = df.sparkSession
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")

    def kept(name: str, table: DataFrame) -> DataFrame:
        path = scratch_path(spark, name)
        table.write.parquet(path)
        return spark.read.parquet(path)

    rows = (rows if _plain(rows) else kept("values", rows)).withColumn("_bin", value_bin(F.col("_v")))
    shape = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    counts = rows.groupBy(*by, "_bin").agg(*shape)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumns({"_cum": F.sum("_c").over(group.orderBy("_bin")), "n": F.sum("_c").over(group)})
    wanted = []
    for label, rank in ranks.items():
        r = rank(F.col("n")).cast("double")
        for side, place in ((0, F.floor(r)), (1, F.ceil(r))):
            wanted.append(
                F.struct(F.lit(label).alias("label"), F.lit(side).alias("side"), place.alias("rank"), (r - F.floor(r)).alias("frac"))
            )
    start = F.col("_cum") - F.col("_c")
    fields = ["_bin", "_lo", "_hi", "_c", "n", "label", "side", "frac", "_rank"]
    hits = (
        counts.withColumn("_w", F.explode(F.filter(F.array(*wanted), lambda w: (w["rank"] >= start) & (w["rank"] < F.col("_cum")))))
        .select(*by, "_bin", "_lo", "_hi", "_c", "n", "_w.label", "_w.side", "_w.frac", (F.col("_w.rank") - start).alias("_rank"))
    )
    hits = kept("ranks", hits)
    part = [*by, "_bin", "_lo", "_hi"]
    hot = (F.col("_c") > most_in_bin) & (F.col("_lo") < F.col("_hi"))
    while not hits.where(hot).isEmpty():
        # rows of hot parts, dealt to narrower parts; a row lies in as many as there are wanted
        open_ = hits.where(hot).select(*part).distinct()
        held = rows.join(open_, [*by, "_bin"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        held = held.withColumnsRenamed({"_lo": "_a", "_hi": "_b"})
        nth = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * PARTS), F.lit(PARTS - 1))
        narrow = held.withColumn("_nth", F.when(F.col("_v") == F.col("_b"), F.lit(PARTS)).otherwise(nth))
        narrow = narrow.groupBy(*by, "_bin", "_a", "_b", "_nth").agg(*shape)
        narrow = narrow.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*by, "_bin", "_a", "_b").orderBy("_nth")))
        old = hits.where(hot).withColumnsRenamed({"_lo": "_a", "_hi": "_b"}).drop("_c")
        both = old.join(narrow, [*by, "_bin", "_a", "_b"]).where((F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("_c")))
        both = both.withColumn("_rank", F.col("_rank") - F.col("_cum") + F.col("_c"))
        hits = kept("ranks", hits.where(~hot).select(*by, *fields).unionByName(both.select(*by, *fields)))
    bins = hits.select(*part).distinct()
    inside = rows.join(bins, [*by, "_bin"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_k"))
    run = Window.partitionBy(*part).orderBy("_v")
    inside = inside.withColumn("_cum", F.sum("_k").over(run))
    picked = inside.join(hits, part).where((F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("_k")))
    low, high = F.max(F.when(F.col("side") == 0, F.col("_v"))), F.max(F.when(F.col("side") == 1, F.col("_v")))
    return picked.groupBy(*by, "label").agg((low + (high - low) * F.max("frac")).alias("value"), F.max("n").alias("n"))


def attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Columns of a small fitted frame on every row: joined by group, or, without groups, its one row as literals."""
    if by:
        return df.join(small, list(by))
    row = small.first()
    return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in small.schema})


def quantiles(df: DataFrame, value: Column | str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantiles in long form: (by..., label, value, n)."""
    ranks = {label: (lambda n, p=p: F.lit(float(p)) * (n - 1)) for label, p in probs.items()}
    return order_stats(df, value, ranks, by)


def quantile_columns(df: DataFrame, value: Column | str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantiles, one column per label."""
    long = quantiles(df, value, probs, by)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("label") == k, F.col("value"))).alias(k) for k in probs])


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column, as fitted values on the driver (one number per column)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s"))
    found = quantiles(long.select("s.k", "s.v"), "v", {"median": 0.5}, ["k"])
    return {r["k"]: r["value"] for r in found.collect()}


def cumulative_counts(df: DataFrame, value: str, sums: Mapping[str, Column], by: Sequence[str] = (), following: str | None = None) -> DataFrame:
    """Distinct values with running totals of ``sums`` up to and including each value.

    Ties are combined map-side; ordering happens per (group, bin), and the bin
    totals, one row per bin, are carried along the group.  ``following`` names a column for
    the next distinct value, which may be the first one of a later bin.
    """
    v = F.col(value).cast("double")
    rows = df.withColumn("_v", v).where("_v IS NOT NULL AND NOT isnan(_v)").withColumn("_bin", value_bin(F.col("_v")))
    vals = rows.groupBy(*by, "_bin", "_v").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    totals = vals.groupBy(*by, "_bin").agg(*[F.sum(k).alias(k) for k in sums], F.min("_v").alias("_first"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by, "_bin",
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_b_{k}") for k in sums],
        *[F.sum(k).over(group).alias(f"{k}_total") for k in sums],
        *([F.lead("_first").over(group.orderBy("_bin")).alias("_later")] if following else []),
    )
    run = Window.partitionBy(*by, "_bin").orderBy("_v")
    inside = vals.withColumns({f"_r_{k}": F.sum(k).over(run) for k in sums})
    if following:
        inside = inside.withColumn("_next", F.lead("_v").over(run))
    joined = inside.join(carried, [*by, "_bin"])
    return joined.select(
        *by, "_bin", F.col("_v").alias(value), *sums,
        *[(F.col(f"_b_{k}") + F.col(f"_r_{k}")).alias(f"{k}_cum") for k in sums], *[f"{k}_total" for k in sums],
        *([F.coalesce("_next", "_later").alias(following)] if following else []),
    )
