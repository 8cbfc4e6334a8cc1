"""Chat sessions as documents, turn memories, web-needed decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T


def session_documents(messages: DataFrame) -> DataFrame:
    """One document a session: a header, then role, id and content of each message in order.

    A session's messages are gathered per session, the unit that becomes one text.
    """
    line = F.concat(F.upper("role"), F.lit(" ["), F.col("turn"), F.lit("]: "), F.col("content"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    return messages.groupBy("session_id").agg(F.concat(F.lit("Chat session "), F.col("session_id"), F.lit("\n"), body).alias("text"), F.count("*").alias("messages"))


def turn_memories(messages: DataFrame) -> DataFrame:
    """A summary per user turn with its answer, and the user's classified sentences."""
    w = Window.partitionBy("session_id").orderBy("turn")
    turns = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("content").over(w)).filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    summary = turns.select("session_id", "turn", F.lit("summary").alias("kind"), F.concat(F.lit("User: "), F.substring("content", 1, 240), F.lit(" Assistant: "), F.substring("answer", 1, 240)).alias("text"), F.lit(0.72).alias("confidence"))
    sentences = turns.select("session_id", "turn", F.explode(F.split("content", "[.\n]")).alias("text")).withColumn("text", F.trim("text")).withColumn("kind", T.sentence_kind(F.col("text"))).filter("kind is not null")
    return summary.unionByName(sentences.select("session_id", "turn", "kind", "text", F.lit(0.66).alias("confidence")))


def web_needed(hits: DataFrame, gate: float = 0.45) -> DataFrame:
    """Queries whose best hit scores below the gate."""
    return hits.groupBy("query_id").agg(F.max("score").alias("best")).withColumn("web_needed", F.col("best") < gate)


def feedback(hits: DataFrame, promote: int = 3, decay: int = 2) -> DataFrame:
    """The best hits of a query are promoted, the worst decayed; a hit is never both."""
    up = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "ordinal")
    down = Window.partitionBy("query_id").orderBy("score", F.desc("document_id"), F.desc("ordinal"))
    rows = hits.withColumn("u", F.row_number().over(up)).withColumn("d", F.row_number().over(down))
    return rows.withColumn("action", F.when(F.col("u") <= promote, "promote").when(F.col("d") <= decay, "decay")).filter("action is not null").drop("u", "d")
