"""Queries on library management, chat, web findings and streams (L, B, K, A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import pages as P
from memspark.operators import chat as C
from memspark.operators import library as L
from memspark.operators import retrieval as R
from memspark.plans import entities as E
from memspark.plans.scratch import shared_path
from memspark.registry import query
from memspark.streaming import accesses as A


def _files(spark, d):
    """Artifacts as recorded, and the disk as the labels imply: some moved, changed or gone."""
    docs = E.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    path = F.concat(F.lit("/library/"), "doc_id")
    artifacts = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "file_hash")
    case = F.col("doc_id") % 10
    disk = docs.filter(case != 3).select(F.when(case == 1, F.concat(F.lit("/moved/"), "doc_id")).otherwise(path).alias("path"), F.when(case == 2, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise(F.col("file_hash")).alias("file_hash"))
    return artifacts, disk


@query("l4_file_updates", """WITH a AS (SELECT doc_id AS id, '/library/' || doc_id AS path, sha256(text) AS h FROM documents), f AS (SELECT CASE WHEN doc_id % 10 = 1 THEN '/moved/' || doc_id ELSE '/library/' || doc_id END AS path, CASE WHEN doc_id % 10 = 2 THEN sha256(doc_id::VARCHAR) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 3),
n AS (SELECT h, count(*) AS copies FROM f GROUP BY h), o AS (SELECT h, count(*) AS owners FROM a GROUP BY h)
SELECT a.id, a.path, CASE WHEN f.h = a.h THEN CASE WHEN owners > 1 OR copies > 1 THEN 'duplicate' ELSE 'unchanged' END WHEN f.h IS NOT NULL THEN CASE WHEN copies IS NOT NULL THEN 'replaced' ELSE 'changed' END WHEN copies IS NOT NULL THEN 'moved' ELSE 'deleted' END AS kind
FROM a LEFT JOIN f USING (path) LEFT JOIN n ON n.h = a.h LEFT JOIN o ON o.h = a.h""")
def l4(spark, d):
    return L.classify_updates(*_files(spark, d))


@query("l5_title_duplicates", f"""WITH t AS (SELECT page_id AS id, list_sort(list_distinct({O.tokens("regexp_extract(html, '<title>([^<]*)', 1)")})) AS t FROM pages), s AS (SELECT * FROM t WHERE len(t) > 0), u AS (SELECT t, min(id) AS unit FROM s GROUP BY t)
SELECT u.unit AS a, s.id AS b, 1.0::DOUBLE AS score FROM s JOIN u USING (t) WHERE s.id <> u.unit
UNION ALL SELECT a, b, score FROM (SELECT x.unit AS a, y.unit AS b, round(len(list_intersect(x.t, y.t))::DOUBLE / len(list_distinct(list_concat(x.t, y.t))), 6) AS score FROM u x JOIN u y ON x.unit < y.unit) WHERE score >= 0.82""")
def l5(spark, d):
    pages = E.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return L.title_duplicates(pages)


_QUEUE = "CASE event_type WHEN 'view' THEN 'run' WHEN 'click' THEN 'finish' WHEN 'signup' THEN 'retry' WHEN 'purchase' THEN 'fail' ELSE 'cancel' END"


@query("l3_queue_states", f"""WITH RECURSIVE e AS (SELECT user_id AS item, {_QUEUE} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT DISTINCT item, 0::BIGINT AS k, 'queued' AS state FROM e UNION ALL SELECT s.item, e.k, CASE WHEN state = 'queued' AND action = 'run' THEN 'running' WHEN state = 'running' AND action = 'finish' THEN 'completed' WHEN state = 'running' AND action = 'fail' THEN 'failed' WHEN state IN ('failed', 'cancelled') AND action = 'retry' THEN 'queued' WHEN state IN ('queued', 'running') AND action = 'cancel' THEN 'cancelled' ELSE state END FROM s JOIN e ON e.item = s.item AND e.k = s.k + 1)
SELECT item, state, k::INT AS actions FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC) = 1""")
def l3(spark, d):
    action = E.lookup(F.col("event_type"), {"view": "run", "click": "finish", "signup": "retry", "purchase": "fail"})
    e = E.read(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.coalesce(action, F.lit("cancel")).alias("action"))
    return L.queue_states(e)


@query("a8_batch_progress", "SELECT user_id % 10 AS batch, count(*) FILTER (event_type = 'view') AS queued, count(*) FILTER (event_type = 'click') AS running, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS cancelled, sum(least(event_id % 7, 5))::BIGINT AS done, (5 * count(*))::BIGINT AS total FROM events GROUP BY 1")
def a8(spark, d):
    state = E.lookup(F.col("event_type"), {"view": "queued", "click": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"})
    items = E.read(spark, d, "events").select((F.col("user_id") % 10).alias("batch"), state.alias("state"), (F.col("event_id") % 7).alias("done"), F.lit(5).cast("long").alias("total"))
    return L.batch_progress(items)


@query("l10_sync_catalogue", "SELECT 'document' AS kind, 'document/' || doc_id AS object_key, sha256(text) AS content_hash, strlen(text)::BIGINT AS bytes FROM documents UNION ALL SELECT 'page', 'page/' || page_id, sha256(html), strlen(html)::BIGINT FROM pages UNION ALL SELECT 'message', 'message/' || conv_id || '/' || turn, sha256(text), strlen(text)::BIGINT FROM conversations")
def l10(spark, d):
    docs, pages, talk = (E.read(spark, d, t) for t in ("documents", "pages", "conversations"))
    parts = [
        L.catalogue("document", docs, F.concat(F.lit("document/"), "doc_id"), F.col("text")),
        L.catalogue("page", pages, F.concat(F.lit("page/"), "page_id"), F.col("html")),
        L.catalogue("message", talk, F.concat_ws("/", F.lit("message"), "conv_id", "turn"), F.col("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("j12_reconcile_ids", "WITH e AS (SELECT sha256(text) AS h, max(doc_id) AS known FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT sha256(text) AS file_hash, coalesce(known, doc_id) AS id FROM documents LEFT JOIN e ON e.h = sha256(text)")
def j12(spark, d):
    docs = E.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"))
    return L.reconcile(docs, docs.filter("id % 2 = 0")).select("file_hash", "id")


@query("b1_chat_documents", "SELECT conv_id AS session_id, 'Chat session ' || conv_id || chr(10) || string_agg(upper(role) || ' [' || turn || ']: ' || text, chr(10) ORDER BY turn, upper(role) || ' [' || turn || ']: ' || text) AS text, count(*) AS messages FROM conversations GROUP BY conv_id")
def b1(spark, d):
    return C.session_documents(E.messages(spark, d))


@query("b8_turn_memories", r"""WITH t AS (SELECT conv_id AS session_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), u AS (SELECT * FROM t WHERE role = 'user' AND next_role = 'assistant')
SELECT session_id, turn, 'summary' AS kind, 'User: ' || left(text, 240) || ' Assistant: ' || left(answer, 240) AS text, 0.72::DOUBLE AS confidence FROM u
UNION ALL SELECT session_id, turn, kind, s, 0.66 FROM (SELECT session_id, turn, s, CASE WHEN lower(s) LIKE '%decided%' OR lower(s) LIKE '%decision%' THEN 'decision' WHEN lower(s) LIKE '%todo%' OR lower(s) LIKE '%task%' OR lower(s) LIKE '%need to%' THEN 'task' WHEN lower(s) LIKE '%remember%' OR lower(s) LIKE '%fact%' THEN 'fact' END AS kind FROM (SELECT session_id, turn, trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS s FROM u)) WHERE kind IS NOT NULL""")
def b8(spark, d):
    return C.turn_memories(E.messages(spark, d))


@query("b3_web_findings", f"WITH {O.FINDINGS} SELECT page_id, domain, content_hash, (retrieved_at + 2592000000)::BIGINT AS expires_at, domain IN {O.in_list(P.RECOGNISED)} OR regexp_matches(domain, '\\.(wikipedia\\.org|docs\\.rs|github\\.com|openai\\.com)$') AS recognised FROM findings")
def b3(spark, d):
    f = E.findings(spark, d)
    return f.select("page_id", "domain", "content_hash", (F.col("retrieved_at") + 2_592_000_000).alias("expires_at"), P.recognised(F.col("domain")).alias("recognised"))


@query("b4_refresh_candidates", f"WITH {O.FINDINGS} SELECT domain, count(*) AS due, min(page_id) AS first_page FROM findings WHERE retrieved_at + 2592000000 <= {E.NOW_MS} GROUP BY domain")
def b4(spark, d):
    f = E.findings(spark, d).filter(F.col("retrieved_at") + 2_592_000_000 <= E.NOW_MS)
    return f.groupBy("domain").agg(F.count("*").alias("due"), F.min("page_id").alias("first_page"))


_HITS = f"""WITH {O.CHUNKS}, q AS (SELECT item_id, tok, count(*) AS uses FROM (SELECT item_id, unnest({O.tokens('text')}) AS tok FROM benchmark) GROUP BY ALL), n AS (SELECT item_id, sum(uses) AS size FROM q GROUP BY ALL), c AS (SELECT DISTINCT document_id, ordinal, unnest({O.tokens('text')}) AS tok FROM chunks),
g AS (SELECT item_id AS query_id, document_id, ordinal, round(sum(uses)::DOUBLE / any_value(size), 6) AS score FROM c JOIN q USING (tok) JOIN n USING (item_id) GROUP BY ALL),
h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal) <= 8)"""


def _hits(spark, d):
    asked = E.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.lexical_hits(E.chunks(spark, d), asked, 8)


@query("p13_web_needed", _HITS + " SELECT query_id, max(score) AS best, max(score) < 0.45 AS web_needed FROM h GROUP BY query_id")
def p13(spark, d):
    return C.web_needed(_hits(spark, d))


@query("b7_attention_feedback", _HITS + " SELECT query_id, document_id, ordinal, action FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal) <= 3 THEN 'promote' WHEN row_number() OVER (PARTITION BY query_id ORDER BY score, document_id DESC, ordinal DESC) <= 2 THEN 'decay' END AS action FROM h) WHERE action IS NOT NULL")
def b7(spark, d):
    return C.feedback(_hits(spark, d)).select("query_id", "document_id", "ordinal", "action")


def _paths(spark, tag):
    root = shared_path(spark, tag)
    return f"{root}/out", f"{root}/state"


@query("stream_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily(spark, d):
    """The access log through a stream; complete days, as all input is processed at once."""
    events = A.read_events(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = _paths(spark, "stream-daily")
    counts = A.daily_counts(events)
    counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(DISTINCT k)::BIGINT AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def session_counts(spark, d):
    """Session windows with a gap of thirty minutes, as the stream has them, over the whole log."""
    e = E.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
