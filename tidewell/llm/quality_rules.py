"""Quality rules with risk-controlled cutoffs, JVM-side only.

A rule rejects a document whose measure is above a cutoff.  The cutoff comes from labelled
documents: per stratum and rule, a fixed list of cutoffs is tested from lenient to strict.
Each test asks whether the share of good documents that the cutoff would reject is below the
allowed risk, by the exact binomial tail of what the holdout shows, and the list ends at the
first failure (fixed-sequence testing, so its length costs nothing).  The error level is
divided by the number of stratum-rule pairs and the risk by the number of rules.  So with
probability 1 - alpha, in no stratum do all rules together reject more than ``risk`` of the
good documents.  A stratum with too few labels keeps everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.text import SPACE_CHARS, whole, words_of
from tidewell.session import scratch_path

SYMBOLS = "#*$%&|<>"
#: Cutoffs of each rule, lenient to strict; a share or a mean above the cutoff is rejected.
CUTOFFS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "mean_word": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0),
}


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines added."""
    body = whole(text)
    df = docs.withColumn("_words", words_of(body)).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.size(F.split(body, f"[{SYMBOLS}]")) - 1).cast("long"))
    df = df.withColumn("_full", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    df = df.withColumn("_lines", F.size("_full")).withColumn("n_dup_lines", (F.col("_lines") - F.size(F.array_distinct("_full"))).cast("long"))
    # each 3-word window's hash with its place, in order of the hash: equal windows are neighbours
    w, n = F.col("_words"), F.col("n_words")
    window = F.transform(w, lambda x, i: F.struct(F.when(i < n - 2, F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.sort_array(window))
    s = F.col("_sorted")
    again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    df = df.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_places", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_words", "_full", "_sorted", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """Value of each rule, null where it has none (no word, no line)."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("_lines")
    return {
        "symbol_share": F.when(chars > 0, F.col("n_symbols") / chars),
        "dup_line_share": F.when(lines > 0, F.col("n_dup_lines") / lines),
        "repeat_share": F.when(words > 0, F.col("n_repeat_words") / words),
        "mean_word": F.when(words > 0, chars / words),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms."""
    import math

    odds, none = math.log(p / (1 - p)), math.log1p(-p)
    first = F.struct((n * none).alias("term"), (n * none).alias("sum"))

    def add(a, j):
        term = a["term"] + F.log((n - j + 1) / j) + odds
        high = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(a["sum"] - high) + F.exp(term - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, first, add, lambda a: a["sum"])))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float, alpha: float, stratum: str = "_stratum") -> DataFrame:
    """(_stratum, rule, cutoff): the strictest certified cutoff; strata and rules without one are absent.

    Every distinct text with a good label that the base rules pass counts as holdout, once in
    its stratum: copies are no trials of their own.  The cutoffs are fixed beforehand, so
    nothing was fitted to it.
    """
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_lid")).distinct()
    held = measured.filter(~F.col("base_failed")).join(good, F.col("_id") == F.col("_lid"), "left_semi").dropDuplicates([stratum, "_mark"])
    counts = [F.sum((v > c).cast("long")).alias(f"{r}@{i}") for r, v in rule_values().items() for i, c in enumerate(CUTOFFS[r])]
    totals = held.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *counts)
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("nth"), F.lit(c).alias("cutoff"), F.coalesce(F.col(f"`{r}@{i}`"), F.lit(0)).alias("k")) for r in CUTOFFS for i, c in enumerate(CUTOFFS[r])])
    tests = totals.select(stratum, "n", F.explode(grid).alias("t")).select(stratum, "n", "t.*")
    every = W.partitionBy(F.lit(1))
    pairs = F.size(F.collect_set(stratum).over(every)) * len(CUTOFFS)
    tests = tests.withColumn("_ok", binomial_tail(F.col("k"), F.col("n"), risk / len(CUTOFFS)) <= alpha / pairs)
    upto = W.partitionBy(stratum, "rule").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    held_so_far = tests.withColumn("_all", F.min(F.col("_ok").cast("int")).over(upto)).filter("_all = 1")
    return held_so_far.groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, alpha: float = 0.05, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    The stratum is a column with few values (a language); null is a stratum of its own.
    Labels with a null id or quality are ignored, an empty table gives no rows, and a text
    without words fails the base rules.  Rows that repeat an id are judged each by their own
    text; a label holds for all of them.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-")).alias("_stratum"), F.col(text).alias("_text"))
    path = scratch_path(docs.sparkSession, "measures")
    measures(rows, "_text").withColumn("_mark", F.xxhash64(F.coalesce(F.col("_text").cast("string"), F.lit("")))).drop("_text").withColumn("base_failed", base_failed()).write.parquet(path)
    measured = docs.sparkSession.read.parquet(path)
    certified = cutoffs(measured, labels, risk, alpha)
    limits = certified.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_limits"))
    judged = measured.join(limits, "_stratum", "left")
    broken = F.array_compact(F.array(*[F.when(v > F.element_at("_limits", r), F.lit(r)) for r, v in rule_values().items()]))
    judged = judged.withColumn("rejected_by", F.coalesce(F.array_sort(broken), F.array().cast("array<string>")))
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return judged.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rejected_by")
