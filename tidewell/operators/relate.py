"""Joins and set operations between panels, profiles and registries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.panel import BY, with_position


def join_without_duplicates(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_ft") -> DataFrame:
    """Left join; columns of the right side that exist on the left are dropped."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    renamed = right.select(*on, *[F.col(c).alias(c + suffix if c in clash else c) for c in right.columns if c not in on])
    return left.join(renamed, list(on), "left").drop(*[c + suffix for c in clash])


def concat_columns(left: DataFrame, right: DataFrame, by=BY, order=("ts",)) -> DataFrame:
    """Columns of two frames side by side, row by position within the series."""
    a = with_position(left, by, order)
    extra = [c for c in right.columns if c not in left.columns]
    b = with_position(right, by, order).select(*by, "t", *extra)
    return a.join(b, [*by, "t"], "left")


#: Bytes of names that may travel with the job; beyond that, pieces of the texts meet them in a join.
NAME_BYTES = 32 << 20


def contains_join(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, q: int = 6, name_bytes: int = NAME_BYTES) -> DataFrame:
    """Distinct (key, name) pairs in which ``text`` holds ``name`` as a substring."""
    names = names.select(F.col(name).cast("string").alias(name)).where(F.length(name) > 0).distinct()
    size = names.agg(F.sum(F.octet_length(name)), F.min(F.octet_length(name))).first()
    if size[0] is None:
        return rows.select(key).limit(0).withColumn(name, F.lit(None).cast("string"))
    if size[0] <= name_bytes:
        return _scan(rows, key, text, [r[0] for r in names.collect()], name, min(q, size[1]))
    return _pieces_join(rows, key, text, names, name, q)


def _scan(rows: DataFrame, key: str, text: str, names: Sequence[str], name: str, q: int) -> DataFrame:
    """One pass over the texts: only places whose next ``q`` bytes begin a name are looked at."""
    known = [n.encode() for n in names]

    def starts_of(data: np.ndarray) -> np.ndarray:
        h = np.zeros(max(0, len(data) - q + 1), np.uint64)
        for j in range(q):
            h = h * np.uint64(0x100000001B3) + data[j : j + len(h)]
        return h * np.uint64(0x9E3779B97F4A7C15)

    lengths: dict[int, set[int]] = {}
    for n in known:
        lengths.setdefault(int(starts_of(np.frombuffer(n[:q], np.uint8))[0]), set()).add(len(n))
    shared = rows.sparkSession.sparkContext.broadcast((frozenset(known), lengths))
    kind = rows.schema[key].dataType

    def find(batches):
        wanted, sizes = shared.value
        first = np.zeros(1 << 16, bool)
        first[[h >> 48 for h in sizes]] = True
        for batch in batches:
            column = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None and len(column) else np.zeros(0, np.uint8)
            places, found = [], []
            for row in range(len(column)):
                own = data[offsets[row] : offsets[row + 1]]
                h = starts_of(own)
                hits = np.flatnonzero(first[h >> np.uint64(48)])
                if len(hits):
                    body = own.tobytes()
                    here = {piece for at, start in zip(hits.tolist(), h[hits].tolist()) for n in sizes.get(start, ()) if (piece := body[at : at + n]) in wanted}
                    places += [row] * len(here)
                    found += sorted(here)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array([f.decode() for f in found], pa.string())], [key, name])

    return rows.select(key, F.col(text).cast("string")).mapInArrow(find, f"`{key}` {kind.simpleString()}, `{name}` string").distinct()


def _pieces_join(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, q: int) -> DataFrame:
    """For more names than may travel with the job.

    Every place in a text gives the piece that starts there.  Pieces meet the
    names' first letters (an equi-join that drops almost all places), then the
    piece cut to each length known for those letters must equal a name.  Each
    place and length meets at most one name, so no pair is tried in vain.
    """
    spread = names.agg(F.min(F.length(name)).alias("lo"), F.max(F.length(name)).alias("hi")).first()
    q = min(q, spread["lo"])
    starts = names.groupBy(F.substr(F.col(name), F.lit(1), F.lit(q)).alias("_start")).agg(F.collect_set(F.length(name)).alias("_lengths"))
    pieces = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{q},{spread['hi']}}}))"), F.lit(1)))
    cut = rows.select(key, F.explode(pieces).alias("_piece")).withColumn("_start", F.substr("_piece", F.lit(1), F.lit(q)))
    tried = cut.join(starts, "_start").withColumn("_len", F.explode("_lengths")).where(F.length("_piece") >= F.col("_len"))
    found = tried.select(key, F.substr("_piece", F.lit(1), F.col("_len")).alias(name)).distinct()
    return found.join(names, name).select(key, name)


def first_mention(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, q: int = 6) -> DataFrame:
    """The alphabetically first name found in each row, NULL where there is none."""
    found = contains_join(rows, key, text, names, name, q).groupBy(key).agg(F.min(name).alias(name))
    return rows.join(found, key, "left")


def lookup_status(wanted: DataFrame, results: DataFrame, key: str, value: str, missing: str = "missing") -> DataFrame:
    """Result per key, and a status for keys that have none."""
    found = results.select(key, value)
    return wanted.join(found, key, "left").withColumn("status", F.when(F.col(value).isNull(), missing).otherwise("ok"))


def hour_profile(df: DataFrame, days: int = 7, by=BY) -> DataFrame:
    """Mean per hour of day over the last ``days`` days of each series."""
    last = F.max("ts").over(Window.partitionBy(*by))
    recent = df.withColumn("_l", last).where(F.col("ts") > F.col("_l") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(*by, F.hour("ts").alias("hour")).agg(F.avg("y").alias("profile"))


def seasonal_naive(df: DataFrame, horizon: int, days: int = 7, by=BY) -> DataFrame:
    """Hourly forecast from the hour profile; hours without one repeat the last value."""
    last = df.groupBy(*by).agg(F.max("ts").alias("a"), F.max_by("y", "ts").alias("last_y"))
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.withColumn("ts", F.col("a") + F.make_dt_interval(hours=F.col("step"))).withColumn("hour", F.hour("ts"))
    return ahead.join(hour_profile(df, days, by), [*by, "hour"], "left").select(
        *by, "ts", "step", F.coalesce("profile", "last_y").alias("yhat")
    )
