"""Chat formatting by grammar round trip, JVM-side only.

A turn is rendered between the marks of its role.  The grammar is strict: the marks are
control strings, no control string may stand inside a content, and every turn names its own
end, so a parser without lookahead reads a conversation from left to right.  Each rendered
turn is parsed again and compared with its source; content that does not come back unchanged
is escaped and tried again until it does.  Then the whole conversation is parsed and compared
with all source turns; the job fails if they differ.

An escape puts one backslash behind the first character of a control string, and of one that
carries backslashes already, so ``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``.
The parser takes one away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks of the roles; other roles are named between the marks of ``OTHER``.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
#: Roles whose content is under the loss mask.
LOSS = ("assistant",)
#: What follows the first character of a control string.
_TAIL = r"(?:/?(?:s>|INST\]|SYS\]|ROLE\])|SAYS\])"
CONTROL = rf"(?:</?s>|\[/?(?:INST|SYS|ROLE)\]|\[SAYS\])"
TURN = r"(?s)(?:\[INST\].*?\[/INST\]|\[SYS\].*?\[/SYS\]|<s>.*?</s>|\[ROLE\].*?\[SAYS\].*?\[/ROLE\])"
#: Tries of a content before the job fails; the second one is enough for any content.
ROUNDS = 3


def escaped(content: Column) -> Column:
    """One backslash more in every control string, bare or escaped."""
    return F.regexp_replace(content, rf"([<\[])(\\*{_TAIL})", r"$1\\$2")


def unescaped(content: Column) -> Column:
    """One backslash less in every escaped control string."""
    return F.regexp_replace(content, rf"([<\[])\\(\\*{_TAIL})", "$1$2")


def rendered(role: Column, content: Column, role_content: Column) -> Column:
    """A turn between its marks; ``role_content`` stands for the role where it has no marks."""
    out = F.concat(F.lit(OTHER[0]), role_content, F.lit(OTHER[1]), content, F.lit(OTHER[2]))
    for name, (opening, closing) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(opening), content, F.lit(closing))).otherwise(out)
    return out


def content_start(role: Column, role_content: Column) -> Column:
    """Characters of a rendered turn before its content."""
    out = F.length(role_content) + len(OTHER[0]) + len(OTHER[1])
    for name, (opening, _) in MARKS.items():
        out = F.when(role == name, F.lit(len(opening))).otherwise(out)
    return out


def _between(piece: Column, opening: str, closing: str) -> Column:
    return F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))


def parsed_turn(piece: Column) -> Column:
    """struct(role, text) of one rendered turn."""
    body = _between(piece, OTHER[0], OTHER[2])
    at = F.instr(body, F.lit(OTHER[1]))
    role, text = F.substring(body, F.lit(1), at - 1), F.substring(body, at + len(OTHER[1]), F.length(body))
    out = F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))
    for name, (opening, closing) in MARKS.items():
        own = F.struct(F.lit(name).alias("role"), unescaped(_between(piece, opening, closing)).alias("text"))
        out = F.when(F.startswith(piece, F.lit(opening)), own).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, array of struct(role, text); null if it is not one.

    The pieces that the grammar finds must make up the whole text, and every control string
    must be a mark of one of them.
    """
    pieces = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    marks = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.when(F.startswith(p, F.lit(OTHER[0])), len(OTHER)).otherwise(2))
    whole = (F.array_join(pieces, "") == formatted) & (marks == F.regexp_count(formatted, F.lit(CONTROL)))
    return F.when(whole, F.transform(pieces, parsed_turn))


def _until_read_back(role: Column, text: Column) -> Column:
    """struct(content, named): content and role, escaped as often as the parser asks for."""
    tries = [(text, role)]
    for _ in range(ROUNDS - 1):
        tries.append((escaped(tries[-1][0]), escaped(tries[-1][1])))
    wanted = F.array(F.struct(role.alias("role"), text.alias("text")))
    out = F.raise_error(F.lit("a turn does not read back")).cast("struct<content:string,named:string>")
    for c, r in reversed(tries):
        same = parse(rendered(role, c, r)).eqNullSafe(wanted)
        out = F.when(same, F.struct(c.alias("content"), r.alias("named"))).otherwise(out)
    return out


def format_chats(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns, loss_mask, n_escaped.

    ``turns`` is what the parser reads back, array of struct(role, text); ``loss_mask`` holds
    start (from 0) and length, in code points of ``formatted``, of every content that a model
    learns; ``n_escaped`` counts the turns that needed an escape.

    Rows are ordered by turn, then role, then text; a null turn comes last.  A null role or
    text is the empty one.  Rows that repeat are turns of their own.  Rows without conv_id do
    not belong together: each is a conversation of one turn with a null id.  An empty table
    gives no rows, other columns are ignored.  A conversation is one row of the result, so its
    text must fit a string (2 GB); its turns meet in one task, other groups there are none.
    """
    source = chats.select(
        F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    order = [F.col("_turn").asc_nulls_last(), "_role", "_text"]

    def pieces(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_try", _until_read_back(F.col("_role"), F.col("_text")))
        rows = rows.withColumn("_content", F.col("_try.content")).withColumn("_named", F.col("_try.named"))
        rows = rows.withColumn("_piece", rendered(F.col("_role"), F.col("_content"), F.col("_named")))
        return rows.withColumn("_size", F.length("_piece").cast("long")).withColumn("_at", content_start(F.col("_role"), F.col("_named")))

    def listed(before: Column, nth: Column) -> Column:
        mask = F.when(F.col("_role").isin(*LOSS), F.struct((before + F.col("_at")).alias("start"), F.length("_content").cast("long").alias("length")))
        escape = (F.col("_content") != F.col("_text")) | (F.col("_named") != F.col("_role"))
        turn_of = F.struct(F.col("_role").alias("role"), F.col("_text").alias("text"))
        return F.struct(nth.alias("nth"), F.col("_piece").alias("piece"), turn_of.alias("turn"), mask.alias("mask"), escape.alias("escape"))

    # the texts move once; the window and the grouping use the same partitioning
    dealt = pieces(source.filter(F.col("_conv").isNotNull()).repartition("_conv"))
    w = W.partitionBy("_conv").orderBy(*order)
    before = F.sum("_size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    many = dealt.withColumn("_before", before).withColumn("_nth", F.row_number().over(w))
    many = many.groupBy("_conv").agg(F.sort_array(F.collect_list(listed(F.col("_before"), F.col("_nth")))).alias("_all"))
    alone = pieces(source.filter(F.col("_conv").isNull())).select("_conv", F.array(listed(F.lit(0).cast("long"), F.lit(1))).alias("_all"))

    out = many.union(alone).withColumn("formatted", F.array_join(F.transform("_all", lambda x: x["piece"]), ""))
    out = out.withColumn("_read", parse(F.col("formatted")))
    same = F.col("_read").eqNullSafe(F.transform("_all", lambda x: x["turn"]))
    bad = F.raise_error(F.lit("a conversation does not read back")).cast("array<struct<role:string,text:string>>")
    return out.select(
        F.col("_conv").alias(conv_id), "formatted", F.when(same, F.col("_read")).otherwise(bad).alias("turns"),
        F.array_compact(F.transform("_all", lambda x: x["mask"])).alias("loss_mask"),
        F.size(F.filter("_all", lambda x: x["escape"])).alias("n_escaped"),
    )


def digests(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Digests of what is read back from the formatted text and its loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"].cast("int")))), "")
    return formatted.withColumn("_learnt", learnt).select(
        conv_id, F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"), F.sha2(F.col("_learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("n_escaped").cast("long").alias("n_escaped"),
    )
