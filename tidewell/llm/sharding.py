"""Sharding by jump consistent hashing: no ring table, and a new shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.ranks import running, slots_for
from tidewell.llm.text import mix, whole


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: the last jump that stays below ``shards``."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        shard[open_] = ahead[open_]
        state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[open_] = np.floor((shard[open_] + 1) * step).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Jump hash of an integer column; null counts as key 0."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix(keys.to_numpy(np.int64).view(np.uint64)), shards))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard without gaps, in the order of a hash of doc_id and
    then doc_id; rows that repeat an id get neighbouring slots.  ``size`` is the text's bytes
    plus 1, a null text has none.  Only the key and three numbers of a row move.
    """
    n = docs.agg(F.count(F.lit(1))).first()[0]
    kept = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(whole(text).cast("binary")).alias("text_crc32"),
        shard_of(F.col(doc_id), shards).alias("shard"),
        shard_of(F.col(doc_id), shards + 1).alias("grown_shard"),
    )
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    slots = slots_for(-(-n // shards))
    numbered = running(kept, ["shard"], draw, [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")], F.lit(1).cast("long"), slots, "_nth")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_nth") - 1).alias("slot"), "grown_shard")
