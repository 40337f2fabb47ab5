"""Queries of conversations: sessions, their last messages, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import catalog as C
from tesserae.plans.registry import Tables, query


@query("W09 A01", "SELECT conv_id, count(*) AS messages, min(turn) AS first, max(turn) AS last, arg_max(text, turn) AS last_text, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def session_list(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.max_by("text", "turn").alias("last_text"), F.max_by("role", "turn").alias("last_role"))


@query("W10", "SELECT conv_id, turn, role, substr(text, 1, 100) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def session_last6(t: Tables) -> DataFrame:
    return C.best_per(t.conversations, ["conv_id"], [F.desc("turn")], 6).select("conv_id", "turn", "role", F.substring("text", 1, 100).alias("text"))


@query("S15 F38", "SELECT conv_id, string_agg('**' || role || '**: ' || substr(text, 1, 300), chr(10) ORDER BY turn) AS body, '' AS review FROM conversations GROUP BY conv_id")
def conversation_export(t: Tables) -> DataFrame:
    """A review sheet: texts cut to 300 characters and an empty column for remarks."""
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("**"), "role", F.lit("**: "), F.substring("text", 1, 300)).alias("s"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("body")).withColumn("review", F.lit(""))


@query("T01", """
SELECT conv_id, turn, array_to_string(list_concat(
  list_transform(string_split(text, ' '), lambda w: 'data: {"type": "content", "text": ' || CAST(to_json(w) AS VARCHAR) || '}' || chr(10) || chr(10)),
  CASE WHEN turn % 3 = 0 THEN ['data: {"type": "error", "detail": "' || CASE WHEN turn % 2 = 0 THEN 'unknown stream error' ELSE 'lost "it"' END || '"}' || chr(10) || chr(10), 'data: {"type": "done"}' || chr(10) || chr(10)] ELSE [] END,
  ['data: {"type": "done", "session_id": "' || conv_id || '"}' || chr(10) || chr(10)]), '') AS events FROM conversations WHERE role = 'assistant'""".replace('lost "it"', 'lost \\"it\\"'))
def event_streams(t: Tables) -> DataFrame:
    """Answers as streams of events, some of which break off."""
    said = t.conversations.where("role = 'assistant'")
    error = F.when(F.col("turn") % 3 == 0, F.when(F.col("turn") % 2 == 0, "").otherwise('lost "it"'))
    events = text.event_stream(F.split("text", " "), error, F.col("conv_id").cast("string"))
    return said.select("conv_id", "turn", F.array_join(events, "").alias("events"))
