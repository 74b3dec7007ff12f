"""Drift of a stream against a reference, from counts that are kept between micro-batches.

Per series the state holds how many values fell into each bin of a fixed width, which is as
large as the range of the values asks and no larger, however many events come.  Every
micro-batch adds its counts and tells the gap and the area between the reference's running
share and that of all values so far.  A series without events for the time to live is
forgotten.  State and progress are committed together, and a batch's result is written under
its number, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "series_id string, n_ref long, n_new long, ks double, area double"
#: Reference bins of all series together that may travel with the job.
MOST_BINS = 1_000_000


def bin_counts(df: DataFrame, width: float, by: Sequence[str] = ("series_id",), y: str = "y") -> DataFrame:
    """(by..., bin, c): values per bin of the given width; missing values do not count."""
    v = F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double"))
    return df.select(*by, F.floor(v / width).alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"))


def binned_drift(reference: DataFrame, new: DataFrame, width: float) -> DataFrame:
    """(series_id, n_ref, n_new, ks, area) of two tables at once: what the stream arrives at."""
    sides = [bin_counts(d, width).withColumn("side", F.lit(s)) for s, d in (("a", reference), ("b", new))]
    both = sides[0].unionByName(sides[1]).groupBy("series_id", "bin").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("c"))), F.lit(0)).alias(s) for s in "ab"])
    w, group = Window.partitionBy("series_id").orderBy("bin"), Window.partitionBy("series_id")
    c = both.withColumns({f"{s}_n": F.sum(s).over(group) for s in "ab"}).where("a_n > 0 AND b_n > 0")
    c = c.withColumns({"gap": F.abs(F.sum("a").over(w) / F.col("a_n") - F.sum("b").over(w) / F.col("b_n")), "next": F.lead("bin").over(w)})
    area = F.sum(F.coalesce(F.col("gap") * (F.col("next") - F.col("bin")) * F.lit(float(width)), F.lit(0.0)))
    return c.groupBy("series_id").agg(F.max("a_n").alias("n_ref"), F.max("b_n").alias("n_new"), F.max("gap").alias("ks"), area.alias("area"))


def distance(known: tuple[np.ndarray, np.ndarray], bins: np.ndarray, counts: np.ndarray, width: float) -> tuple[float, float]:
    """Largest gap and area between two running shares given as counts per bin."""
    places = np.unique(np.concatenate([known[0], bins]))
    a, b = np.zeros(len(places)), np.zeros(len(places))
    a[np.searchsorted(places, known[0])] = known[1]
    b[np.searchsorted(places, bins)] = counts
    gap = np.abs(a.cumsum() / a.sum() - b.cumsum() / b.sum())
    return float(gap.max()), float((gap[:-1] * np.diff(places)).sum() * width)


def running_drift(events: DataFrame, reference: DataFrame, path: str, checkpoint: str, width: float, keep: str = "30 days", delay: str = "1 day") -> StreamingQuery:
    """Starts the stream: (series_id, ts, y) events against a reference table, results under ``path``/batch=n.

    The reference travels as its bin counts, whose number is checked.  A series
    whose last event lies ``keep`` behind the watermark (the latest time seen, less ``delay``)
    is forgotten; that is time of the events, so a replay forgets the same.  Events that come
    later than ``delay`` after younger ones do not count.
    """
    counts = bin_counts(reference, width)
    if (n := counts.count()) > MOST_BINS:
        raise ValueError(f"the reference has {n} bins; take a larger width")
    table = counts.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("bins")).collect()
    known = {r["series_id"]: (np.array([b["bin"] for b in r["bins"]], np.int64), np.array([b["c"] for b in r["bins"]], np.int64)) for r in table}
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[keep.split()[1].rstrip("s")]
    keep_ms = int(keep.split()[0]) * unit * 1000

    def add(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        bins, c, last = held.get if held.exists else ([], [], held.getCurrentWatermarkMs())
        bins, c = np.array(bins, np.int64), np.array(c, np.int64)
        for pdf in rows:
            v = pdf["y"].to_numpy(float)
            every = np.concatenate([bins, np.floor(v[~np.isnan(v)] / width).astype(np.int64)])
            times = np.concatenate([c, np.ones(len(every) - len(c), np.int64)])
            bins, place = np.unique(every, return_inverse=True)
            c = np.bincount(place, times, len(bins)).astype(np.int64)
            last = max(last, int(pdf["ms"].max()))
        held.update((bins.tolist(), c.tolist(), last))
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + keep_ms)
        if len(bins) and key[0] in known:
            ks, area = distance(known[key[0]], bins, c, width)
            yield pd.DataFrame({"series_id": [key[0]], "n_ref": [int(known[key[0]][1].sum())], "n_new": [int(c.sum())], "ks": [ks], "area": [area]})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    keyed = timed.select(F.col("series_id").cast("string").alias("series_id"), "ts", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"), F.col("y").cast("double").alias("y"))
    scored = keyed.groupBy("series_id").applyInPandasWithState(add, RESULT, "bins array<long>, counts array<long>, last long", "update", GroupStateTimeout.EventTimeTimeout)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return scored.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(history: DataFrame) -> DataFrame:
    """The last result of every series out of all batches."""
    return history.groupBy("series_id").agg(F.max_by(F.struct("n_ref", "n_new", "ks", "area"), "batch").alias("s")).select("series_id", "s.*")
