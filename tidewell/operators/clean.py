"""Schema detection, projection, filters and filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.calendar import cycle
from tidewell.functions.numbers import safe_ratio, to_number, to_time
from tidewell.operators.quantiles import column_medians
from tidewell.panel import BY, over

# Column names looked for, in order of preference.
TARGET_PREFERENCE = ("temperature", "temp", "value", "air_temp", "anomaly", "mean")
VALUE_PREFERENCE = ("mean_temp", "temperature", "temp", "value", "y", "air_temp")
TARGET_CANDIDATES = ("mean_temp", "mean temperature", "temperature", "temp", "t")
DATE_CANDIDATES = ("month", "date", "Month", "Date")
TARGET_KEYWORDS = ("mean_temp", "mean temperature", "meantemp", "meanTemp", "tmean", "temp", "temperature")


# --- schema ------------------------------------------------------------------


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType)]


def string_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.StringType)]


def detect_target(schema: T.StructType, preference: Sequence[str] = TARGET_PREFERENCE, skip: Sequence[str] = ()) -> str:
    """First numeric column whose name holds a preferred word, else the first numeric one."""
    names = [c for c in numeric_columns(schema) if c.lower() not in skip]
    if not names:
        raise ValueError("no numeric column to use as target")
    return next((c for word in preference for c in names if word in c.lower()), names[0])


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case."""
    by_name = {}
    for c in columns:
        by_name.setdefault(c.lower(), c)
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def detect_date(df: DataFrame, candidates: Sequence[str] = DATE_CANDIDATES) -> str:
    """Named date column, else the first column that is a date or mostly parses as one."""
    named = find_column(df.columns, candidates)
    if named:
        return named
    first = df.schema[0]
    if isinstance(first.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return first.name
    seen = df.select(F.col(first.name).cast("string").alias("c")).agg(F.count("c").alias("n"), F.count(to_time(F.col("c"))).alias("k")).first()
    if seen["n"] and seen["n"] == seen["k"]:
        return first.name
    raise ValueError("no date column found")


# --- projection --------------------------------------------------------------


def canonical(df: DataFrame, ts: str, y: str) -> DataFrame:
    return df.select(F.col(ts).alias("ts"), F.col(y).alias("y"))


def align_schema(df: DataFrame, expected: Sequence[str], fill: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected columns, in order, as doubles; missing ones hold ``fill``."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c).cast("double") if c in have else F.lit(float(fill))).alias(c) for c in expected])


def numeric_projection(df: DataFrame, required: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Numeric and boolean columns as doubles: required ones first, extras kept."""
    usable = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    as_double = {f.name: F.col(f.name).cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast("double") for f in df.schema if f.name in usable}
    first = [as_double.get(c, F.lit(float(fill))).alias(c) for c in required]
    return df.select(*first, *[as_double[c].alias(c) for c in usable if c not in required])


def strip_prefix(name: Column) -> Column:
    """``num__x`` -> ``x``."""
    return F.regexp_replace(name, r"^.*?__", "")


def strip_prefixes(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c.split("__", 1)[1] if "__" in c else c) for c in df.columns])


def exogenous(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"exog_{c}") for c in columns])


# --- filters -----------------------------------------------------------------


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, total, null_frac) in one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("total") - F.col(f"_{i}")).alias("nulls"), "total") for i, c in enumerate(columns)])
    return counted.select(F.inline(rows)).withColumn("null_frac", safe_ratio(F.col("nulls"), F.col("total")))


def drop_sparse(df: DataFrame, limit: float = 0.5, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with a null share above ``limit``."""
    sparse = [r["column"] for r in null_profile(df, columns).where(F.col("null_frac") > limit).collect()]
    return df.drop(*sparse)


def drop_empty(df: DataFrame) -> DataFrame:
    empty = [r["column"] for r in null_profile(df).where(F.col("nulls") == F.col("total")).collect()]
    return df.drop(*empty)


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct, total): NULL counts as one value; long texts are compared by digest."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.md5(F.col(c).cast("string")).alias("v")) for c in columns]))
    counted = df.select(pairs.alias("p")).select("p.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("c").alias("total"))


def drop_high_cardinality(df: DataFrame, limit: float = 0.5, label: str | None = None) -> DataFrame:
    """Drop string columns with more than ``limit`` x rows distinct values."""
    names = [c for c in string_columns(df.schema) if c != label]
    if not names:
        return df
    wide = cardinality(df, names).where(F.col("distinct") > limit * F.col("total")).collect()
    return df.drop(*[r["column"] for r in wide])


def duplicate_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], rtol=1e-5, atol=1e-8) -> DataFrame:
    """(column, same_as, same): equal up to tolerance in every row, NULL equal to NULL."""

    def close(a, b):
        x, z = to_number(F.col(a)), to_number(F.col(b))
        return x.eqNullSafe(z) | F.coalesce(F.abs(x - z) <= atol + rtol * F.abs(z), F.lit(False))

    one = df.agg(*[F.bool_and(close(a, b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("column"), F.lit(b).alias("same_as"), F.col(f"_{i}").alias("same")) for i, (a, b) in enumerate(pairs)])))


def drop_duplicates_of(df: DataFrame, prefix: str = "y_") -> DataFrame:
    """Drop ``y_x`` where it repeats ``x``."""
    pairs = [(c, c[len(prefix):]) for c in df.columns if c.startswith(prefix) and c[len(prefix):] in df.columns]
    if not pairs:
        return df
    return df.drop(*[r["column"] for r in duplicate_pairs(df, pairs).where("same").collect()])


def numeric_pairs(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows in which both values are numbers."""
    out = df.withColumns({truth: to_number(F.col(truth)), pred: to_number(F.col(pred))})
    return out.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())


# --- coercion ----------------------------------------------------------------


def coerce_objects(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns to numbers: numeric if any value parses (nulls 0), else epoch seconds, else 0."""
    columns = list(columns or string_columns(df.schema))
    seen = df.agg(
        *[F.count(to_number(F.col(c))).alias(f"n_{c}") for c in columns], *[F.count(to_time(F.col(c))).alias(f"t_{c}") for c in columns]
    ).first()
    new = {}
    for c in columns:
        if seen[f"n_{c}"]:
            new[c] = F.coalesce(to_number(F.col(c)), F.lit(0.0))
        elif seen[f"t_{c}"]:
            new[c] = F.unix_timestamp(to_time(F.col(c))).cast("double")
        else:
            new[c] = F.lit(0.0)
    return df.withColumns(new)


def numeric_ratio(df: DataFrame, columns: Sequence[str], needed: int = 0, keywords: Sequence[str] = TARGET_KEYWORDS) -> DataFrame:
    """(column, numeric, total, ratio, score), best target candidate first.

    The score adds 0.25 for a target-like name and 0.05 for enough rows.
    """
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(to_number(F.col(c).cast("string"))).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = []
    for i, c in enumerate(columns):
        bonus = 0.25 if any(k in c.lower() for k in keywords) else 0.0
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("numeric"), "total", F.lit(bonus).alias("_b")))
    out = counted.select(F.inline(F.array(*rows))).withColumn("ratio", safe_ratio(F.col("numeric"), F.col("total")))
    long_enough = F.when(F.col("total") >= needed, 0.05).otherwise(0.0)
    return out.withColumn("score", F.col("ratio") + F.col("_b") + long_enough).drop("_b").orderBy(F.desc("score"), "column")


def month_number(df: DataFrame, candidates: Sequence[str] = ("month_num", "month", "date", "ds", "timestamp")) -> Column:
    """Month 1..12 from a number, else from text that is a date, else from a date column."""
    options = []
    for name in candidates:
        c = find_column(df.columns, [name])
        if c is None:
            continue
        kind = df.schema[c].dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            options.append(F.month(c))
        elif isinstance(kind, T.NumericType):
            options.append(F.col(c).cast("int"))
        else:
            options += [F.col(c).try_cast("int"), F.month(to_time(F.col(c)))]
    if not options:
        raise ValueError("no column to take the month from")
    return F.coalesce(*options)


# --- filling -----------------------------------------------------------------


def fill_both_ways(y: str, by=BY, order=("ts",)) -> Column:
    w = over(by, order)
    ahead = F.last(y, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(ahead, F.first(y, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact column median, 0 where a column holds no value."""
    med = column_medians(df, columns)
    return df.na.fill({c: float(med.get(c) or 0.0) for c in columns})


def impute_lags(df: DataFrame, columns: Sequence[str], y: str = "y", by=BY, order=("ts",)) -> DataFrame:
    """Forward fill, back fill, column median of the series, target median of the series."""
    whole = Window.partitionBy(*by)
    return df.withColumns(
        {c: F.coalesce(fill_both_ways(c, by, order), F.median(c).over(whole), F.median(y).over(whole)) for c in columns}
    )


def fit_imputer(train: DataFrame, columns: Sequence[str], strategy: str) -> dict[str, object]:
    """Fill values learned from the training rows: mean, median or most_frequent (ties: smallest)."""
    if strategy == "mean":
        row = train.agg(*[F.avg(c).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    if strategy == "median":
        return column_medians(train, columns)
    if strategy != "most_frequent":
        raise ValueError(f"unknown strategy {strategy}")
    out = {}
    for c in columns:
        top = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).first()
        out[c] = top[c] if top else None
    return out


def apply_imputer(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


# --- calendar grid -----------------------------------------------------------

STEP = {"month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR"}


def regular_grid(df: DataFrame, grain: str = "month", by=BY) -> DataFrame:
    """Every calendar step between first and last row; inserted steps hold NULL."""
    spans = df.groupBy(*by).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = spans.select(*by, F.explode(F.sequence("a", "b", F.expr(STEP[grain]))).alias("ts"))
    return grid.join(df, [*by, "ts"], "left")


def infer_frequency(df: DataFrame, by=BY) -> DataFrame:
    """Median gap in days -> (series, gap_days, freq): 'MS' for about a month, else 'D'."""
    gap = F.datediff("ts", F.lag("ts").over(over(by)))
    gaps = df.withColumn("_g", gap).where("_g IS NOT NULL").groupBy(*by).agg(F.floor(F.median("_g")).alias("gap_days"))
    month = (F.col("gap_days") % 30 == 0) | F.col("gap_days").between(28, 31)
    return gaps.withColumn("freq", F.when(month, "MS").otherwise("D"))


def repeat_last(df: DataFrame, n: int, by=BY) -> DataFrame:
    """Append n copies of each series' last row, one month apart."""
    others = [c for c in df.columns if c not in (*by, "ts")]
    last = df.groupBy(*by).agg(F.max_by(F.struct("ts", *others), "ts").alias("r"))
    ahead = last.select(*by, "r.*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
    moved = ahead.withColumn("ts", (F.col("ts") + F.make_ym_interval(F.lit(0), F.col("_k"))).cast(df.schema["ts"].dataType)).drop("_k")
    return df.unionByName(moved.select(df.columns))


def future_frame(df: DataFrame, horizon: int, by=BY) -> DataFrame:
    """The next ``horizon`` months per series with calendar covariates."""
    last = df.groupBy(*by).agg(F.max("ts").alias("a"))
    ahead = last.select(*by, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "a")
    ahead = ahead.withColumn("ts", F.col("a") + F.make_ym_interval(F.lit(0), F.col("step"))).drop("a")
    s, c = cycle(F.month("ts"))
    return ahead.withColumns({"year": F.year("ts").cast("double"), "month_sin": s, "month_cos": c})


def synthetic_date(t: Column, month: Column) -> Column:
    """A date for tables that only know the month number: year 2000 + t // 12."""
    return F.make_date((F.lit(2000) + F.floor(t / 12)).cast("int"), month.cast("int"), F.lit(1))
