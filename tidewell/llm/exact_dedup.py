"""Exact deduplication by content-defined chunk recipes, JVM-side only.

A text is cut where its own content says so, so equal stretches of different texts give
equal chunks.  Every distinct chunk gets an identifier (its SHA-256) that is verified: all
occurrences behind an identifier are compared byte by byte, through their smallest and
largest value, before the identifier may be used.  A document is then just the ordered list
of its identifiers, and documents are equal when these lists are; long texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import SPACES, whole
from tidewell.session import scratch_path

#: A chunk ends after one of these letters and a space, or after a full stop of East Asian
#: scripts, not before 384 and not after 4096 characters.
CHUNK = "(?s).{384,4094}?(?:[dlz]\\x20|\\u3002)|.{1,4096}"

#: Rows from which a recipe may count as hot, and tasks that share the rows of a hot one.
HOT_ROWS, PARTS = 1000, 64


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole(text), SPACES, " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks; an empty text is one empty chunk."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)))


def identifier(chunk: Column) -> Column:
    """First half of the chunk's SHA-256; ``verify`` makes sure that no two chunks share one."""
    return F.substring(F.unhex(F.sha2(chunk.cast("binary"), 256)), 1, 16)


def verify(texts: DataFrame) -> None:
    """Compares all chunks (column ``_text``) behind each identifier; a shared one ends the job.

    Every distinct chunk of a task moves once, then only identifiers do.
    """
    each = texts.select(F.explode(chunks(F.col("_text"))).alias("_chunk"))
    each = each.select(identifier(F.col("_chunk")).alias("_key"), "_chunk").distinct()
    if not each.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        raise ValueError("two chunks share an identifier")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sha, recipe, rows): one row per distinct id and text; ``rows`` counts repeats."""
    clean = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("_text"))
    verify(clean)
    listed = clean.select("doc_id", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("sha"), F.transform(chunks(F.col("_text")), identifier).alias("recipe"))
    return listed.groupBy("doc_id", "sha", "recipe").agg(F.count(F.lit(1)).alias("rows"))


def hot_recipes(one: DataFrame) -> list[int]:
    """Hashes of recipes that more than a thousandth of the rows have: a thousand at most."""
    seen = one.groupBy(F.xxhash64("recipe").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_ROWS, one.count() // 1000)
    return [r["hash"] for r in seen.filter(F.col("n") > least).collect()]


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after each run of white space became one space; a null text is the
    empty text.  The smallest doc_id of a group stays (a null id only if the group has no
    other; ``keep_id`` is null then).  Rows that repeat id and text are listed as often as
    they occur and the first of them is kept.  Texts of any length are cut into chunks of at
    most 4096 characters.  An empty table gives no rows.  Other columns are ignored.
    """
    path = scratch_path(docs.sparkSession, "recipes")
    recipes(docs, doc_id, text).write.parquet(path)
    one = docs.sparkSession.read.parquet(path)
    # the rows of a recipe that many documents have are dealt to several tasks
    hot = F.xxhash64("recipe").isin(hot_recipes(one))
    groups = one.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    groups = groups.withColumn("_part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
    dealt = one.withColumn("_part", F.when(hot, F.pmod(F.xxhash64("doc_id", "sha"), F.lit(PARTS))).otherwise(0).cast("int"))
    rows = dealt.join(groups, ["recipe", "_part"]).select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"))
    return rows.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
