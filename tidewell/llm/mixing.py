"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle, once through per epoch.  A
document's virtual finish time is the tokens its source has sent up to and including it,
divided by the source's target.  All queues are range-sorted by that time as one stream,
which is cut where the running total reaches the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.draws import portable_uniform
from tidewell.llm.ranks import running, slots_for
from tidewell.llm.text import whole, word_count
from tidewell.session import scratch_path

#: Seed of the shuffle.
SEED = 17


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source_key, source_size, target, rank): one row per source.

    Sources rank by code point, null last; weights repeat along that rank.  They share
    ``share`` times all sizes; no target exceeds ``epochs`` times its source, and what is
    above is shared again by weight.  That fixed point is a water level: a source gets its
    cap or level times weight, whichever is less.
    """
    each = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    order = W.orderBy("source_key")
    rank = (F.row_number().over(order) - 1).cast("int")
    table = each.withColumn("rank", rank).withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    table = table.withColumn("_cap", F.col("source_size") * float(epochs)).withColumn("_at", F.col("_cap") / F.col("_weight"))
    every = W.partitionBy()
    up_to = W.orderBy("_at", "rank").rowsBetween(W.unboundedPreceding, 0)
    table = (
        table.withColumn("_budget", F.sum("source_size").over(every) * share)
        .withColumn("_full", F.sum("_cap").over(up_to))
        .withColumn("_open", F.sum("_weight").over(every) - F.sum("_weight").over(up_to))
        .withColumn("_capped", F.col("_full") + F.col("_at") * F.col("_open") <= F.col("_budget"))
    )
    capped = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("_capped"), F.col("_weight"))).over(every)
    level = (F.col("_budget") - capped) / free
    return table.select("source_key", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(level * F.col("_weight")).alias("target"), "rank", "_budget")


def source_key(source: Column) -> Column:
    """Sort key of a source that is never null: nulls after all names."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = SEED,
                  doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    ``size`` is the number of words (null text: 0), ``taken`` is ``copies`` times it, and
    ``copies`` runs from 0 to ``epochs``.  Documents are taken whole.  A document without words
    is taken once; an empty table gives no rows.  Rows that repeat an id are documents of
    their own.  The same rows give the same mix however they are partitioned.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "mix")
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_key(F.col(source)).alias("source_key"), word_count(whole(text)).alias("size")).write.parquet(path)
    sized = spark.read.parquet(path)
    goal = targets(sized, weights, share, epochs)
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    draw = portable_uniform(seed, ["doc_id", "size"])
    queue = running(sized, ["source_key"], draw, [F.col("doc_id").asc_nulls_last(), F.col("size")], F.col("size"), slots_for(n), "_sent")
    queue = queue.join(goal.drop("_budget"), "source_key")
    timed = scratch_path(spark, "mix")
    queue.write.parquet(timed)
    queue = spark.read.parquet(timed)
    finish = [F.when(F.col("target") > 0, (F.col("_sent") + F.col("source_size") * e) / F.col("target")).otherwise(F.lit(0.0)) for e in range(epochs)]
    stamps = [F.struct(f.alias("time"), F.col("rank").alias("rank"), F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), F.lit(e).alias("epoch")) for e, f in enumerate(finish)]
    sent = queue.filter("size > 0").select("size", F.explode(F.array(*stamps)).alias("_stamp"))
    # times run to any height; t / (1 + t) keeps their order within [0, 1)
    stream = running(sent.withColumn("_all", F.lit(0)), ["_all"], F.col("_stamp.time") / (1 + F.col("_stamp.time")), [F.col("_stamp")], F.col("size"), slots_for(epochs * n), "_total")
    last = stream.filter(F.col("_total") <= share * float(total)).agg(F.max("_stamp").alias("last")).first()["last"]
    if last is None:
        copies = F.lit(0)
    else:
        cut = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["rank"]).alias("rank"), F.lit(last["id"]).alias("id"), F.lit(last["epoch"]).alias("epoch"))
        copies = sum(((s <= cut).cast("int") for s in stamps), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(1))
    return queue.withColumn("copies", copies.cast("int")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
