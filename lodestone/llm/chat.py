r"""Chat formatting with a grammar round trip, in SQL functions only.

Grammar: conversation = turn*; turn = "### " role ": " text "</turn>\n". A backslash in role or text
takes the next character literally, so neither ends in one that takes no character, nor does a role
hold an end mark. A conversation is rendered as it is, the rendering is parsed again, and the recovered
turns are compared with the source; where they differ, conflicting content (backslashes, "### ",
"</turn>", in roles also ": ") is escaped and the comparison repeated. A conversation that still
differs stops the job, so every result has proved its round trip.

The loss mask covers the rendering's characters (code points) as runs: of each turn its head, its text
and its end mark, with their lengths and whether a model is trained on them, which it is on the texts
of assistants. The lengths of a conversation's runs add up to its rendering's length.

Defined cases: null role or text counts as empty; turns sort by number (null first), then role, then
text, and repeated rows stay; rows with a null conversation id form one conversation; an empty table
gives an empty result; other columns are ignored. A conversation is one value of its row, as its
digest asks for, so a single conversation is limited to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, COLON, END = "### ", ": ", "</turn>"


def escape(value: Column, role: bool = False) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for mark in (START, END, *([COLON] if role else [])):
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def render(turns: Column, escaped: bool) -> Column:
    role = lambda t: escape(t["role"], True) if escaped else t["role"]
    text = lambda t: escape(t["text"]) if escaped else t["text"]
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t), F.lit(COLON), text(t), F.lit(f"{END}\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendering; a malformed turn has a null role, so it equals no source turn."""
    def turn(token: Column) -> Column:
        head = F.substring_index(token, COLON, 1)
        rest = F.substring(token, F.length(head) + 1 + len(COLON), F.length(token))
        text = F.substring(rest, F.lit(1), F.length(rest) - len(END) - 1)
        open_ = lambda x: (F.length(x) - F.length(F.rtrim(x, F.lit("\\")))) % 2 == 1  # noqa: E731  a backslash that would take the mark
        whole = F.endswith(rest, F.lit(f"{END}\n")) & (F.instr(rest, END) == F.length(rest) - len(END)) & ~F.contains(head, F.lit(END)) & ~open_(head) & ~open_(text)
        return F.struct(F.when(whole, unescape(head)).alias("role"), unescape(text).alias("text"))

    tokens = F.split(formatted, START, -1)
    return F.transform(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), turn)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, escaped, loss_mask (runs: chars, loss): one row per conversation."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns"))
    convs = convs.select("conv_id", F.transform(F.array_sort("turns"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    convs = convs.withColumn("plain", render(F.col("turns"), False))
    convs = convs.withColumn("escaped", ~parse(F.col("plain")).eqNullSafe(F.col("turns")))
    convs = convs.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain")))
    proved = F.when(~F.col("escaped") | parse(F.col("formatted")).eqNullSafe(F.col("turns")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))

    def runs(t: Column) -> Column:
        size = lambda x, role: F.length(F.when(F.col("escaped"), escape(x, role)).otherwise(x))
        run = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
        return F.array(run(size(t["role"], True) + len(START + COLON), F.lit(False)), run(size(t["text"], False), t["role"] == "assistant"), run(F.lit(len(END) + 1), F.lit(False)))

    return convs.select("conv_id", proved.alias("formatted"), "escaped", F.flatten(F.transform("turns", runs)).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from the rendering alone. A mask that does not
    cover the rendering stops the job."""
    covered = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x["chars"]) == F.length("formatted")
    formatted = formatted.withColumn("formatted", F.when(covered, F.col("formatted")).otherwise(F.raise_error(F.lit("a loss mask does not cover its conversation"))))
    rows = formatted.select("conv_id", "formatted", "loss_mask", parse(F.col("formatted")).alias("turns"))
    rows = rows.select(
        "*", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join(F.transform(F.filter("turns", lambda t, i: F.get(F.col("loss_mask"), 3 * i + 1)["loss"]), lambda t: t["text"]), "").alias("loss"))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))),
n AS (SELECT *, regexp_matches(text, '\\|### |</turn>') OR regexp_matches(role, '\\|### |</turn>|: ') AS bad,
             length(role) + length(text) + 14 AS plain,
             length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'))
             + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ')) + 14 AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (CASE WHEN bool_or(bad) THEN sum(esc) ELSE sum(plain) END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
