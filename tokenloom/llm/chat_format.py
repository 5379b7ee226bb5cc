"""Chat formatting with a grammar that survives a round trip, in SQL functions only.

A turn is written between the marks of its role, and a conversation is its turns one after another:

    system      [SYS]text[/SYS]
    user        [INST]text[/INST]
    assistant   [ASST]text</s>
    any other   [ROLE:hex of the role]text[/ROLE]

A conversation is first rendered as it is, parsed again and compared with its turns. Where they differ, because
texts contain marks or escaped marks, those turns are escaped that do not survive on their own: each mark in
them gets one more backslash after its first character, which the parser removes. The conversation is then
rendered, parsed and compared again; if it still differs all its turns are escaped, and if it differs after
that too the query fails, so no output goes unverified. (One round is enough by construction: no escaped text
contains a mark, and a mark that begins in a text cannot end in the closing mark.) The loss mask covers the
texts of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stage

#: Roles with marks of their own.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "</s>")}
#: Renderings of a conversation at most: nothing escaped, the conflicting turns, all turns.
ROUNDS = 3
#: A mark, or a mark that was escaped before: first character, backslashes, the rest.
_CONTROL = r"([\[<])(\\*)(/?SYS\]|/?INST\]|ASST\]|/s>|ROLE:[0-9A-F]*\]|/ROLE\])"
_ESCAPED = r"([\[<])\\(\\*)(/?SYS\]|/?INST\]|ASST\]|/s>|ROLE:[0-9A-F]*\]|/ROLE\])"
_TURN = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|\[ASST\].*?</s>|\[ROLE:[0-9A-F]*\].*?\[/ROLE\]"


def _open(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE:"), F.hex(F.encode(role, "UTF-8")), F.lit("]"))
    for name, (mark, _) in MARKS.items():
        other = F.when(role == name, F.lit(mark)).otherwise(other)
    return other


def _close(role: Column) -> Column:
    other = F.lit("[/ROLE]")
    for name, (_, mark) in MARKS.items():
        other = F.when(role == name, F.lit(mark)).otherwise(other)
    return other


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, masked), texts unescaped."""

    def turn(raw: Column) -> Column:
        role = F.expr("null").cast("string")
        head, tail = F.length(F.regexp_extract(raw, r"^\[ROLE:[0-9A-F]*\]", 0)), F.lit(len("[/ROLE]"))
        role = F.decode(F.unhex(F.regexp_extract(raw, r"^\[ROLE:([0-9A-F]*)\]", 1)), "UTF-8")
        for name, (a, b) in MARKS.items():
            own = raw.startswith(a)
            role, head, tail = F.when(own, F.lit(name)).otherwise(role), F.when(own, F.lit(len(a))).otherwise(head), F.when(own, F.lit(len(b))).otherwise(tail)
        return F.struct(role.alias("role"), unescaped(F.substring(raw, head + 1, F.length(raw) - head - tail)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def _same(turns: Column, formatted: Column) -> Column:
    """Whether the parser recovers just the roles and texts of these turns."""
    return parsed(formatted).eqNullSafe(F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn, role, text, conflict, starts, chars.

    conflict says whether the turn, rendered as it is, is parsed as another. starts and chars have the span of
    its text in the formatted conversation after each round: nothing escaped, the conflicting turns, all. Null
    texts and roles are empty; rows with equal turns stand in order of role and text; null turns come first,
    and rows with a null conv_id form one conversation. Other columns are ignored, whatever their names.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    head, tail = _open(F.col("role")), _close(F.col("role"))
    rows = rows.withColumn("conflict", ~_same(F.array(F.struct("role", "text")), F.concat(head, F.col("text"), tail)))
    rows = rows.withColumn("marks", F.length(head)).withColumn("rest", F.length(tail)).withColumn("plain", F.length("text")).withColumn("more", F.length(escaped(F.col("text"))))
    rows = rows.withColumn("chars", F.array("plain", F.when(F.col("conflict"), F.col("more")).otherwise(F.col("plain")), "more"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.sum(F.col("marks") + F.get("chars", F.lit(r)) + F.col("rest")).over(before), F.lit(0)) + F.col("marks") for r in range(ROUNDS)]
    return rows.withColumn("starts", F.array(*start)).select("conv_id", "turn", "role", "text", "conflict", "starts", "chars")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in characters) and escape_rounds.

    The turns of one conversation are one text in the end, so they meet in one row; nothing else does.
    """
    item = F.struct("turn", "role", "text", "conflict", "starts", "chars")
    state = format_turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t"))

    def rendered(level: int) -> Column:
        """The conversation after so many rounds."""
        escape = lambda x: [F.lit(False), x["conflict"], F.lit(True)][level]
        turn = lambda x: F.concat(_open(x["role"]), F.when(escape(x), escaped(x["text"])).otherwise(x["text"]), _close(x["role"]))
        return F.array_join(F.transform("t", turn), "")

    state = state.withColumn("formatted", rendered(0)).withColumn("escape_rounds", F.lit(0))
    for level in range(1, ROUNDS):
        state = state.withColumn("same", _same(F.col("t"), F.col("formatted")))
        state = state.withColumns({"formatted": F.when(F.col("same"), F.col("formatted")).otherwise(rendered(level)), "escape_rounds": F.when(F.col("same"), F.col("escape_rounds")).otherwise(level)})
    lost = F.raise_error(F.concat(F.lit("the grammar loses conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    state = state.withColumn("formatted", F.when(_same(F.col("t"), F.col("formatted")), F.col("formatted")).otherwise(lost))
    own = lambda x: F.struct(F.get(x["starts"], F.col("escape_rounds")).alias("start"), F.get(x["chars"], F.col("escape_rounds")).alias("chars"))
    return state.select("conv_id", "formatted", F.transform(F.filter("t", lambda x: x["role"] == "assistant"), own).alias("loss_spans"), "escape_rounds")


def round_trip(formatted: DataFrame) -> DataFrame:
    """What the parser recovers from format_conversations' output: per conversation turns, digests and loss text."""
    turns = formatted.select("conv_id", "formatted", "loss_spans", "escape_rounds", parsed(F.col("formatted")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["chars"].cast("int"))))
    out = turns.select("conv_id", "turns", "formatted", F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.array_join(loss, "").alias("loss_text"), "escape_rounds")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "turns_sha256",
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escape_rounds",
    )


def with_conflict(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two turns both say what looks like an end and a turn."""
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    extra = F.inline(F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, (c, k) in zip(r, (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))) for r in rows)))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.unionByName(conversations.sparkSession.range(1).select(extra))


def formatted_and_read(conversations: DataFrame) -> DataFrame:
    """Formats all conversations into the shared folder, reads them back and parses them."""
    return round_trip(stage(format_conversations(with_conflict(conversations)), "chats"))


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, CASE role WHEN 'system' THEN '[/SYS]' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/ROLE]' END AS tail FROM c),
t AS (SELECT *, CASE WHEN contains(text, tail) OR regexp_matches(text, '{_ESCAPED}') THEN regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g') ELSE text END AS body,
    CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 10 ELSE 14 + 2 * octet_length(encode(role)) END AS marks FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(marks + length(body)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
