"""Deleting, rebuilding and auditing as commits to a ledger: the tables after the change, not counts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.ledger import APPEND, REPLACE, Ledger


def save_all(ledger: Ledger, batch: str, tables: dict[str, DataFrame]) -> int:
    """Overwrite all tables in one commit."""
    return ledger.commit(batch, {name: (REPLACE, rows) for name, rows in tables.items()})


def delete_documents(ledger: Ledger, batch: str, gone: DataFrame, owned: dict[str, str], trained: Column) -> int:
    """Delete documents (doc_id) and all rows of the owned tables (table -> its column of document ids).

    `model` (state, reason) turns stale if a model was trained on one of them (`trained`, over the table documents).
    """
    ids = gone.select(F.col("doc_id").alias("gone")).distinct()
    left = lambda name, key: ledger.read(name).join(ids, F.col(key) == F.col("gone"), "left_anti")
    hit = ledger.read("documents").filter(trained).join(ids, F.col("doc_id") == F.col("gone"), "left_semi").agg(F.count("*").alias("n"))
    model = ledger.read("model").crossJoin(F.broadcast(hit))  # one row each
    stale = F.col("n") > 0
    model = model.select(F.when(stale, "stale").otherwise(F.col("state")).alias("state"), F.when(stale, "a source it was trained on is gone").otherwise(F.col("reason")).alias("reason"))
    tables = {"documents": "doc_id"} | owned
    return ledger.commit(batch, {name: (REPLACE, left(name, key)) for name, key in tables.items()} | {"model": (REPLACE, model)})


def rebuild(ledger: Ledger, batch: str, documents: DataFrame, chunks: DataFrame, present: DataFrame, deleted: DataFrame, embed: Column) -> int:
    """Rebuild documents (doc_id, state) and chunks (doc_id, ordinal, text_hash, embedding, reused) from the sources.

    Deleted documents go; one whose source isn't present is marked missing; a chunk whose text hash has a stored
    embedding takes it, and only the others are embedded. documents, present, deleted: doc_id; chunks: doc_id, ordinal, text, text_hash.
    """
    flag = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    kept = documents.join(flag(deleted, "deleted"), "doc_id", "left_anti").join(flag(present, "present"), "doc_id", "left")
    kept = kept.select("doc_id", F.when(F.col("present").isNull(), "missing").otherwise("kept").alias("state"))
    live = chunks.join(flag(deleted, "deleted"), "doc_id", "left_anti")
    cache = ledger.read("chunks").groupBy("text_hash").agg(F.first("embedding").alias("stored"))  # equal texts have equal embeddings
    found = live.select("doc_id", "ordinal", "text_hash").join(cache, "text_hash").select("doc_id", "ordinal", "text_hash", F.col("stored").alias("embedding"), F.lit(True).alias("reused"))
    new = live.join(cache.select("text_hash"), "text_hash", "left_anti").select("doc_id", "ordinal", "text_hash", embed.alias("embedding"), F.lit(False).alias("reused"))
    return ledger.commit(batch, {"documents": (REPLACE, kept), "chunks": (REPLACE, found.union(new))})


def audit_events(writes: DataFrame, event: str) -> DataFrame:
    """event_id, kind, event, target_id of writes (kind, target_id, payload); an id follows from what was written."""
    return writes.select(F.md5(F.concat_ws(":", F.lit(event), "kind", "target_id", "payload")).alias("event_id"), "kind", F.lit(event).alias("event"), "target_id").distinct()


def write_audited(ledger: Ledger, batch: str, marks: DataFrame, memories: DataFrame) -> int:
    """Add marks (target_id, action) and memories (target_id, text), with an audit event for each write, in one commit."""
    new = marks.select("target_id", "action", F.lit(None).cast("string").alias("reverted_by"))
    writes = marks.select(F.lit("attention_mark").alias("kind"), "target_id", F.col("action").alias("payload")).union(memories.select(F.lit("derived_memory"), "target_id", "text"))
    return ledger.commit(batch, {"marks": (APPEND, new), "memories": (APPEND, memories), "audit": (APPEND, audit_events(writes, "write"))})


def revert_marks(ledger: Ledger, batch: str, chosen: DataFrame) -> int:
    """Set reverted_by on the live marks of the chosen (target_id, action), with an audit event for each."""
    pick = chosen.select("target_id", "action").distinct().withColumn("chosen", F.lit(True))
    marks = ledger.read("marks").join(pick, ["target_id", "action"], "left")
    now = F.col("chosen").isNotNull() & F.col("reverted_by").isNull()
    events = audit_events(marks.filter(now).select(F.lit("attention_mark").alias("kind"), "target_id", F.col("action").alias("payload")), "revert")
    after = marks.select("target_id", "action", F.when(now, F.lit(batch)).otherwise(F.col("reverted_by")).alias("reverted_by"))
    return ledger.commit(batch, {"marks": (REPLACE, after), "audit": (APPEND, events)})
