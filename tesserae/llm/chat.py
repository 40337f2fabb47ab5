"""Chat formatting: turns to one marked text a conversation, with a loss mask, and back again.

Spark expressions only: the turns of a conversation are collected as structs and sorted, runs
of turns of one role become one block, and blocks are concatenated. The template is

    <turn:ROLE>TEXT<next>TEXT</turn>\\n

with one `<turn:ROLE>` for a block and `<next>` between the turns merged into it, so that the
original turns can be read back. Inside texts and roles `\\` becomes `\\s` and `<` becomes `\\l`
(and `>` in roles `\\g`), so no text can contain or imitate a mark.

Defined cases: null texts and roles are empty; turns are ordered by turn, role, text, nulls
first, so ties and repeated rows have one order and all stay; rows with a null id form one
conversation; an empty table gives no row; columns besides the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, END, NEXT = "<turn:", ">", "</turn>\n", "<next>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: its id, `formatted`, and `loss_spans` as (start, length) in code
    points of `formatted`, from 0, one for each turn of `loss_role` in order."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("body"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("given"))
    # Sorted as given: escaped texts would sort ties differently.
    safe = F.transform(
        "given",
        lambda t: F.struct(
            F.replace(escape(t["role"]), F.lit(">"), F.lit("\\g")).alias("role"),
            escape(t["body"]).alias("body"),
            (t["role"] == loss_role).alias("learn"),
        ),
    )
    chats = chats.select("conv_id", safe.alias("turns"))
    # The mark before each turn: a new block where the role differs from the turn before.
    chats = chats.withColumn("marked", F.expr(f"""
        transform(turns, (t, i) -> struct(
            CASE WHEN i = 0 THEN concat('{OPEN}', t.role, '{SHUT}')
                 WHEN t.role = turns[i - 1].role THEN '{NEXT}'
                 ELSE concat('</turn>\\n', '{OPEN}', t.role, '{SHUT}') END AS mark,
            t.body AS body, t.learn AS learn))"""))
    chats = chats.withColumn("formatted", F.concat(F.array_join(F.expr("transform(marked, m -> concat(m.mark, m.body))"), ""), F.lit(END)))
    spans = F.expr("""
        aggregate(marked,
            struct(0L AS at, CAST(array() AS array<struct<start: bigint, length: bigint>>) AS spans),
            (a, m) -> struct(
                a.at + length(m.mark) + length(m.body) AS at,
                CASE WHEN m.learn
                     THEN array_append(a.spans, struct(a.at + length(m.mark) AS start, CAST(length(m.body) AS bigint) AS length))
                     ELSE a.spans END AS spans),
            a -> a.spans)""")
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """`formatted` rows with `turns` (role and text of each original turn, in order) and
    `loss_text` (all text under the loss mask, unescaped), read from the formatted text alone."""
    parts = F.expr("""
        flatten(transform(
            filter(split(formatted, '</turn>\\n', -1), b -> b <> ''),
            b -> transform(
                split(substring(b, instr(b, '>') + 1), '<next>', -1),
                t -> struct(substring(b, 7, instr(b, '>') - 7) AS role, t AS text))))""")
    plain = F.transform(F.col("parts"), lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["text"]).alias("text")))
    loss = F.transform(F.col("loss_spans"), lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("parts", parts).select("*", plain.alias("turns"), F.array_join(loss, "").alias("loss_text")).drop("parts")


def digests(read: DataFrame) -> DataFrame:
    """The contract's columns of what was read back."""
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The rows of `turns` and the contract's conversation -7, whose texts imitate marks."""
    said = "\\### Assistant: </turn> ok"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(replace(replace(text, '\', '\s'), '<', '\l')) AS body,
         length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) AS name
  FROM raw)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + CASE WHEN before = role THEN 6 ELSE name + 15 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
