"""Queries on changes of state: delete, rebuild, citations, audit trail, message anchors (L, N, B, X rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import hashing as H
from memspark.operators import library as L
from memspark.operators import retrieval as R
from memspark.operators import signals as S
from memspark.operators.digests import group_digest, group_digest_sql
from memspark.plans import entities as E
from memspark.queries_retrieval import asked, hybrid_sql
from memspark.registry import query

NOW = E.NOW_MS


def _toxic(spark, d):
    return E.read(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()


_GONE = "gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"
_SPLIT = "CASE WHEN n <= 6 THEN 'train' WHEN n = 7 THEN 'eval' ELSE 'test' END"


@query("l7_delete_cascade", f"""WITH {O.CHUNKS}, {O.MARKS}, {O.ACCESSES}, {_GONE}, kept AS (SELECT 'documents' AS kind, doc_id FROM documents UNION ALL SELECT 'chunks', document_id FROM chunks UNION ALL SELECT 'marks', target_id FROM marks UNION ALL SELECT 'accesses', target_id FROM accesses),
model AS (SELECT bool_or(('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT % 10 <= 6) AS stale FROM documents SEMI JOIN gone USING (doc_id))
SELECT kind, count(*) AS before, count(*) FILTER (doc_id NOT IN (FROM gone)) AS after, coalesce((SELECT stale FROM model), false) AS model_stale FROM kept GROUP BY kind""")
def l7(spark, d):
    """Deleting documents takes their chunks, marks and accesses along; a model trained on one of them is stale."""
    gone = _toxic(spark, d)
    docs = E.read(spark, d, "documents").select("doc_id")
    tables = {"documents": docs, "chunks": E.chunk_spans(spark, d).select(F.col("document_id").alias("doc_id")), "marks": E.marks(spark, d).select(F.col("target_id").alias("doc_id")), "accesses": E.accesses(spark, d).select(F.col("target_id").alias("doc_id"))}
    return L.delete_cascade(tables, gone, H.split_name(F.col("doc_id").cast("string")) == "train")


@query("l2_rebuild", f"""WITH {O.CHUNKS}, {_GONE}, seen AS (SELECT DISTINCT user_id AS doc_id FROM events), cache AS (SELECT DISTINCT md5(text) AS h FROM chunks SEMI JOIN (SELECT doc_id AS document_id FROM labels WHERE quality = 1) USING (document_id)),
fate AS (SELECT doc_id, CASE WHEN doc_id IN (FROM gone) THEN 'deleted' WHEN doc_id NOT IN (FROM seen) THEN 'missing' ELSE 'kept' END AS fate FROM documents)
SELECT fate, count(DISTINCT doc_id) AS documents, count(document_id) AS chunks, count(document_id) FILTER (fate <> 'deleted' AND md5(text) IN (FROM cache)) AS reused, count(document_id) FILTER (fate <> 'deleted' AND md5(text) NOT IN (FROM cache)) AS embedded FROM fate LEFT JOIN chunks ON document_id = doc_id GROUP BY fate""")
def l2(spark, d):
    """A rebuild drops deleted documents, marks those whose files are gone as missing, and embeds only texts without a cached vector.

    Files that nobody accessed stand for missing ones; texts of good documents are in the cache.
    """
    docs = E.read(spark, d, "documents").select("doc_id")
    seen = E.read(spark, d, "events").select(F.col("user_id").alias("doc_id"))
    chunks = E.chunks(spark, d).select(F.col("document_id").alias("doc_id"), F.md5("text").alias("text_hash"))
    good = E.read(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    return L.rebuild(docs, chunks, seen, _toxic(spark, d), chunks.join(good, "doc_id", "left_semi").select("text_hash"))


@query("n13_cite_anchors", f"""WITH {hybrid_sql(k=1)}, {O.ACCESSES}, cites AS (SELECT document_id AS target_id, 'cite' AS kind, {NOW} AS accessed_at FROM hits), every AS (SELECT target_id, kind, accessed_at FROM accesses UNION ALL FROM cites),
s AS (SELECT target_id, round(least(0.6, sum(({O.ACCESS_WEIGHT})::DOUBLE * CASE WHEN (greatest({NOW} - accessed_at, 0) / 604800000::DOUBLE) >= 1 THEN 0.25::DOUBLE ELSE 0.45::DOUBLE + 0.55::DOUBLE * (1 - (greatest({NOW} - accessed_at, 0) / 604800000::DOUBLE)) END)), 6)::DOUBLE AS access_score FROM every WHERE accessed_at >= {NOW} - 2592000000 GROUP BY target_id)
SELECT item_id AS query_id, 'chunk:' || document_id || ':' || ordinal || ':anchor' AS anchor_id, access_score FROM hits JOIN s ON target_id = document_id""")
def n13(spark, d):
    """The best passage of each query is cited: its anchor, and its document's access score with the citations logged."""
    best = R.hybrid_scores(E.embedded_chunks(spark, d), asked(spark, d), 1)
    cites = best.select(F.col("document_id").alias("target_id"), F.lit("cite").alias("kind"), F.lit(NOW).alias("accessed_at"))
    scores = S.access_scores(E.accesses(spark, d).select("target_id", "kind", "accessed_at").union(cites), NOW)
    anchor = F.concat_ws(":", F.lit("chunk"), "document_id", "ordinal", F.lit("anchor"))
    return best.select("query_id", anchor.alias("anchor_id"), F.col("document_id").alias("target_id")).join(scores, "target_id").select("query_id", "anchor_id", "access_score")


@query("b10_audit_trail", f"""WITH {O.MARKS}, writes AS (SELECT 'attention_mark' AS kind, target_id, action AS payload FROM marks UNION ALL SELECT 'derived_memory', conv_id, left(text, 240) FROM conversations WHERE role = 'assistant'),
ev AS (SELECT kind, 'write' AS event, target_id, md5(kind || ':' || target_id || ':' || payload) AS h FROM writes UNION ALL SELECT 'attention_mark', 'revert', target_id, md5('attention_mark:' || target_id || ':' || action) FROM marks WHERE action = 'suppress' AND target_id IN (SELECT target_id FROM marks WHERE action = 'promote'))
SELECT kind, event, events, targets, digest FROM (SELECT kind, event, count(*) AS events, count(DISTINCT target_id) AS targets FROM ev GROUP BY ALL) JOIN ({group_digest_sql('SELECT DISTINCT kind, event, h AS line FROM ev', 'kind, event')}) USING (kind, event)""")
def b10(spark, d):
    """Marks and derived memories with their audit events; a suppression that a promotion contradicts is reverted, which is an event too."""
    marks = E.marks(spark, d).select(F.lit("attention_mark").alias("kind"), "target_id", F.col("action").alias("payload"))
    memories = E.messages(spark, d).filter("role = 'assistant'").select(F.lit("derived_memory").alias("kind"), F.col("session_id").alias("target_id"), F.substring("content", 1, 240).alias("payload"))
    up = marks.filter("payload = 'promote'").select("target_id").distinct()
    events = L.audited(marks.union(memories), "write").union(L.audited(marks.filter("payload = 'suppress'").join(up, "target_id", "left_semi").select("kind", "target_id", "payload"), "revert"))
    counts = events.groupBy("kind", "event").agg(F.count("*").alias("events"), F.countDistinct("target_id").alias("targets"))
    return counts.join(group_digest(events.select("kind", "event", F.col("event_id").alias("line")).distinct(), ["kind", "event"]), ["kind", "event"])


@query("x10_message_anchors", """SELECT conv_id AS session_id, turn, 'message:' || conv_id || ':' || turn AS anchor_id, (start_at - size)::BIGINT AS start, start_at::BIGINT AS "end" FROM (SELECT *, length('Chat session ' || conv_id) + sum(size + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS start_at FROM (SELECT conv_id, turn, role, text, length(upper(role) || ' [' || turn || ']: ' || text) AS size FROM conversations))""")
def x10(spark, d):
    """Where each message lies in its session's document; ids are made of session and turn."""
    m = E.messages(spark, d).withColumn("size", F.length(F.concat(F.upper("role"), F.lit(" ["), F.col("turn"), F.lit("]: "), F.col("content"))))
    order = Window.partitionBy("session_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, 0)
    end = F.length(F.concat(F.lit("Chat session "), F.col("session_id"))) + F.sum(F.col("size") + 1).over(order)
    return m.select("session_id", "turn", F.concat_ws(":", F.lit("message"), "session_id", "turn").alias("anchor_id"), (end - F.col("size")).alias("start"), end.alias("end"))
