"""Applying per-document decisions to the documents themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.text import whole


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not use."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name = "_" + name
    return name


def _columns(docs: DataFrame, alias: str):
    return [F.col(f"{alias}.`{c}`") for c in docs.columns]


def copies_of(docs: DataFrame, copies: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Each document as often as ``copies`` (doc_id, copies) says; ids not listed go.

    A null id matches a null id.  ``copies`` has one row per id.  Columns stay as they are.
    """
    key, nth = _free(docs, "_doc"), _free(docs, "_copy")
    right = copies.select(F.col("doc_id").alias("_key"), F.col("copies").cast("int").alias("_copies")).alias("_right")
    joined = docs.withColumn(key, F.col(doc_id)).alias("_left").join(right, F.col(f"_left.{key}").eqNullSafe(F.col("_right._key")))
    many = joined.filter(F.col("_right._copies") > 0)
    return many.select(*_columns(docs, "_left"), F.explode(F.sequence(F.lit(1), F.col("_right._copies"))).alias(nth)).drop(nth)


def text_key(text: str = "text") -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(whole(text))


def first_rows(docs: DataFrame, kept: DataFrame, key: Column, name: str, doc_id: str = "doc_id") -> DataFrame:
    """Documents listed in ``kept`` (doc_id and column ``name``) by id and ``key``; of rows with both equal, one.

    A null id matches a null id.  Columns stay as they are.
    """
    own, none, mark, nth = (_free(docs, n) for n in ("_doc", "_none", "_mark", "_nth"))
    keys = [own, none, mark]

    def keyed(df: DataFrame, id_: Column, value: Column) -> DataFrame:
        return df.withColumn(own, F.coalesce(id_.cast("long"), F.lit(0))).withColumn(none, id_.isNull()).withColumn(mark, value)

    listed = keyed(kept, F.col("doc_id"), F.col(name)).select(*keys).distinct()
    # the window and the join deal by the same columns, so documents move once
    one = keyed(docs, F.col(f"`{doc_id}`"), key).withColumn(nth, F.row_number().over(W.partitionBy(*keys).orderBy(mark))).filter(F.col(nth) == 1)
    return one.join(listed, keys, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
