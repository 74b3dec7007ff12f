"""Registered queries of the corpus operators, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import bpe, chat, classifier, exact_dedup, language_model, mixing, near_dedup, negatives, quality_rules, search, sharding, substrings, suffixes
from tidewell.plans.registry import table, uniform_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)



WORD = r"[^\x20\x09-\x0D]+"
RISK, ALPHA = 0.02, 0.05


def _rules_sql() -> str:
    """Base measures, exact binomial tests of every cutoff, and the strictest certified ones."""
    rules = {
        "symbol_share": "n_symbols / nullif(word_chars, 0)", "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
        "repeat_share": "n_repeat_words / nullif(n_words, 0)", "mean_word": "word_chars / nullif(n_words, 0)",
    }
    p = RISK / len(rules)
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cuts in quality_rules.CUTOFFS.items() for i, c in enumerate(cuts))
    tail = f"(SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))) FROM range(0, k + 1) x(j))"
    return (
        f"WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, "
        f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM documents), "
        "t AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'k': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]})) AS s FROM w), "
        "r AS (SELECT doc_id, s.i AS i, count(*) OVER (PARTITION BY doc_id, s.k) > 1 AS again FROM t), "
        "c AS (SELECT doc_id, sum(least(3, i - before))::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r WHERE again) GROUP BY 1), "
        "m AS (SELECT w.doc_id, x, coalesce('=' || lang, '-') AS g, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, "
        f"(length(x) - length(regexp_replace(x, '[{quality_rules.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, "
        "coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)), "
        "b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m), "
        "v AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, g, x, base_failed, '{r}' AS rule, {e} AS v FROM b" for r, e in rules.items()) + ")), "
        f"cuts(rule, nth, cutoff) AS (VALUES {grid}), "
        "h AS (SELECT DISTINCT g, x, rule, v FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), "
        "q AS (SELECT g, rule, nth, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM h JOIN cuts USING (rule) GROUP BY ALL), "
        f"ok AS (SELECT *, (CASE WHEN k >= n THEN 1 ELSE {tail} END) <= {ALPHA} / ((SELECT count(DISTINCT g) FROM q) * {len(rules)}) AS ok FROM q), "
        "held AS (SELECT *, bool_and(ok) OVER (PARTITION BY g, rule ORDER BY nth) AS so_far FROM ok), "
        "lim AS (SELECT g, rule, min(cutoff) AS cutoff FROM held WHERE so_far GROUP BY 1, 2), "
        "bad AS (SELECT doc_id, list(rule ORDER BY rule) AS rules FROM v JOIN lim USING (g, rule) WHERE v > cutoff GROUP BY 1) "
        "SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, []) AS rejected_by FROM b LEFT JOIN bad USING (doc_id)"
    )


@query("op1_quality_rules", _rules_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), RISK, ALPHA)


MIX_SQL = (
    f"WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents), "
    "s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY 1), "
    "w AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS wt, 2 * source_size::DOUBLE AS cap FROM s), "
    "f AS (SELECT *, sum(cap) OVER o AS filled, sum(wt) OVER () - sum(wt) OVER o AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w WINDOW o AS (ORDER BY cap / wt, rank ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT *, filled + cap / wt * rest <= budget AS capped FROM f), "
    "t AS (SELECT source, source_size, rank, budget, CASE WHEN capped THEN cap ELSE (budget - (SELECT coalesce(sum(cap), 0) FROM c WHERE capped)) / (SELECT sum(wt) FROM c WHERE NOT capped) * wt END AS target FROM c), "
    f"q AS (SELECT doc_id, size, source_size, target, rank, budget, sum(size) OVER (PARTITION BY d.source ORDER BY {uniform_sql(mixing.SEED, 'doc_id', 'size')}, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent "
    "FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source), "
    "e AS (SELECT *, (sent + source_size * epoch)::DOUBLE / target AS finish FROM q, range(0, 2) r(epoch) WHERE size > 0), "
    "z AS (SELECT doc_id, budget, sum(size) OVER (ORDER BY finish, rank, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS total FROM e), "
    "n AS (SELECT doc_id, (count(*) FILTER (total <= budget))::INT AS copies FROM z GROUP BY 1) "
    "SELECT doc_id, size, source_size, target, coalesce(copies, 1) * size AS taken, coalesce(copies, 1) AS copies FROM q LEFT JOIN n USING (doc_id)"
)


@query("op2_source_mix", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


COPIES_SQL = (
    r"WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) "
    "SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM n WINDOW g AS (PARTITION BY t)"
)


@query("op3_exact_dedup", COPIES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_context_tree_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), corpus_pipeline.vocabulary(), digests=True)


WINDOW_SQL = (
    f"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents), "
    "p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'i': i, 'word': ws[i], 'key': CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END})) AS s FROM w), "
    "f AS (SELECT doc_id, s.i AS i, s.word AS word, (s.key IS NOT NULL AND row_number() OVER (PARTITION BY s.key ORDER BY doc_id, s.i) > 1)::INT AS later FROM p), "
    "c AS (SELECT *, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f), "
    "g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY 1) "
    "SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)"
)


@query("op9_substring_dedup", WINDOW_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_suffixes(table(spark, sf_dir, "documents"))


SEARCH_SQL = (
    r"WITH t AS (SELECT row_number() OVER () AS d, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), "
    "lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM documents), "
    "c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM t WHERE len(ts) > 0), "
    "p AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(ts) AS term FROM t) GROUP BY 1, 2), "
    r"q AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), "
    "lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark), "
    "f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c), "
    "m AS (SELECT d, doc_id, 50 + (50 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM t, c), "
    "s AS (SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (d) GROUP BY 1, 2, 3), "
    "r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0) "
    "SELECT * FROM r WHERE rank <= 50"
)


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEGATIVES_SQL = (
    "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings "
    "WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score "
    "FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), "
    "p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5), "
    "n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score "
    "FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score) "
    "SELECT * FROM n WHERE rank <= 10"
)


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(rows)


#: Characters that a template adds to a turn, and what an escape would touch.
_CHAT_MARKS = "CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END"
_CHAT_ESCAPE = r"[<\[]\\*(?:/?(?:s>|INST\]|SYS\]|ROLE\])|SAYS\])"
CHAT_SQL = (
    "WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))), "
    f"e AS (SELECT *, len(regexp_extract_all(text, '{_CHAT_ESCAPE}')) AS n FROM t) "
    "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, "
    "sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256, "
    f"sum({_CHAT_MARKS} + length(text) + n)::BIGINT AS formatted_chars, count(*) FILTER (n > 0) AS n_escaped FROM e GROUP BY 1"
)


@query("op13_chat_format", CHAT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat.digests(chat.format_chats(chats.unionByName(said)))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
