"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn; adjacent turns of the same role are merged
into one block by array aggregation; the blocks are concatenated. The text is

    <turn>role LF text [<and/> text ...] </turn> LF     for each block

and the loss mask is a run-length list over it: for each turn a run of markup (not learnt) and a run of text (learnt
where the role is in loss_roles), then a run for the last closing mark.

Escapes: inside roles and texts "\\" becomes "\\b" and "<" becomes "\\l"; in roles line feeds become "\\n". So "<" in
the output always opens a mark, and undoing "\\n", "\\l" and "\\b" in this order gives back the original, whatever it held.

Nulls: a null text or role is an empty one; rows with a null turn sort first; rows with a null conversation id form
one conversation of their own. Repeated rows stay; equal turn numbers are ordered by role, then text. An empty table
gives no rows. Other columns are ignored. The text of a conversation is one string value, so a conversation has to
fit a row (2 GB).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import table

OPEN, JOIN, CLOSE = "<turn>", "<and/>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(turns: Column) -> Column:
    """Sorted turns -> array<struct<role, texts array<string>>>, adjacent turns of a role merged; linear in turns."""

    def of(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i)["role"] != F.get(a, i - 1)["role"]))

        def merged(bounds: Column) -> Column:
            def block(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(bounds, k + 1), F.size(a))
                return F.struct(F.get(a, start)["role"].alias("role"), F.transform(F.slice(a, start + 1, end - start), lambda t: t["text"]).alias("texts"))

            return F.transform(bounds, block)

        return _let(starts, merged)

    return _let(turns, of)


def _piece(markup: Column, text: Column, learnt: Column) -> Column:
    return F.struct(markup.alias("markup"), text.alias("text"), learnt.alias("learnt"))


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted string, loss_runs array<struct<chars int, learnt boolean>>), a row for each conversation."""
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.replace(escaped(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"), F.lit("\\n")).alias("role"),
            escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("row"),
    )
    learnt_roles = F.array(*[F.lit(r).cast("string") for r in loss_roles]) if loss_roles else F.array().cast("array<string>")

    def pieces(blocks: Column) -> Column:
        def of(block: Column, b: Column) -> Column:
            first = F.concat(F.when(b > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), block["role"], F.lit("\n"))
            learnt = F.array_contains(learnt_roles, role_unescaped(block["role"]))
            return F.transform(block["texts"], lambda t, i: _piece(F.when(i == 0, first).otherwise(F.lit(JOIN)), t, learnt))

        return F.flatten(F.transform(blocks, of))

    runs = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.array(
                F.struct(F.length(p["markup"]).alias("chars"), F.lit(False).alias("learnt")),
                F.struct(F.length(p["text"]).alias("chars"), p["learnt"].alias("learnt")),
            ),
        )
    )
    last = F.array(F.struct(F.lit(len(CLOSE)).alias("chars"), F.lit(False).alias("learnt")))
    return (
        rows.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("row")).alias("turns"))
        .select("conv_id", pieces(_blocks(F.col("turns"))).alias("pieces"))
        .select(
            "conv_id",
            F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["markup"], p["text"])), ""), F.lit(CLOSE)).alias("formatted"),
            F.concat(runs, last).alias("loss_runs"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text, learnt>>) from format_chats()'s output; fails where mask and text disagree."""
    marks = F.filter(F.split("formatted", "<", -1), lambda m: F.startswith(m, F.lit("turn>")) | F.startswith(m, F.lit("and/>")))
    n_head = len("turn>")
    raw = F.transform(
        marks,
        lambda m: F.when(
            F.startswith(m, F.lit("turn>")),
            F.struct(F.substring_index(F.substr(m, F.lit(n_head + 1)), "\n", 1).alias("role"), F.substr(m, F.instr(m, F.lit("\n")) + 1).alias("text")),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("role"), F.substr(m, F.lit(n_head + 1)).alias("text"))),
    )

    def with_roles(turns: Column) -> Column:
        """A joined turn has the role of the block's first."""
        starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["role"].isNotNull())

        def spread(bounds: Column) -> Column:
            return F.flatten(
                F.transform(bounds, lambda s, k: F.transform(F.sequence(s, F.coalesce(F.get(bounds, k + 1), F.size(turns)) - 1), lambda i: F.struct(F.get(turns, s)["role"].alias("role"), F.get(turns, i)["text"].alias("text"))))
            )

        return _let(starts, spread)

    def checked(turns: Column) -> Column:
        runs = F.col("loss_runs")
        return F.transform(
            turns,
            lambda t, i: F.struct(
                role_unescaped(t["role"]).alias("role"),
                unescaped(t["text"]).alias("text"),
                F.when(F.get(runs, 2 * i + 1)["chars"] == F.length(t["text"]), F.get(runs, 2 * i + 1)["learnt"]).otherwise(F.raise_error(F.lit("loss mask and text differ")).cast("boolean")).alias("learnt"),
            ),
        )

    return formatted.select("conv_id", "formatted", checked(_let(raw, with_roles)).alias("turns"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    extra = reduce(DataFrame.unionAll, (spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for i, r in enumerate(("user", "assistant"))))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_chats(turns))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: "|| CAST" stands for role LF text LF. The length of the text adds, to each turn's escaped text, its block's marks.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n') AS erole,
         replace(replace(text, '\', '\b'), '<', '\l') AS etext FROM t
), s AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL AS joined,
         row_number() OVER w AS pos
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, etext)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(etext) + CASE WHEN joined THEN 6 ELSE 15 + length(erole) END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
