"""Queries on stored state: the tables after a delete, a rebuild, audited writes, and an index that is refreshed (K, L, B, I rows).

Each writes its tables to a ledger in shared scratch storage, changes them, and repeats every change, which must have no second effect.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import hashing as H
from memspark.functions import vector as V
from memspark.operators import state_changes as C
from memspark.operators import stored_index as X
from memspark.operators.digests import group_digest, group_digest_sql
from memspark.operators.graph import sequence_links
from memspark.operators.ledger import Ledger
from memspark.plans import entities as E
from memspark.plans.scratch import shared_path, written
from memspark.queries_state import _GONE, _toxic
from memspark.registry import query


def _ledger(spark) -> Ledger:
    return Ledger(spark, shared_path(spark, "ledger"))


def _twice(change, *args) -> None:
    """A change whose driver starts over writes its batch again."""
    assert change(*args) == change(*args)


_CORE = {
    "documents": "SELECT doc_id || ':' || sha256(text) AS line FROM documents",
    "chunks": """SELECT document_id || ':' || ordinal || ':' || start || ':' || "end" AS line FROM chunks""",
    "marks": "SELECT target_id || ':' || action AS line FROM marks",
    "accesses": "SELECT event_id || ':' || target_id || ':' || kind || ':' || accessed_at AS line FROM accesses",
    "messages": "SELECT conv_id || ':' || turn || ':' || role || ':' || sha256(text) AS line FROM conversations",
    "findings": "SELECT page_id || ':' || domain || ':' || content_hash AS line FROM findings",
    "links": "SELECT document_id || ':' || ordinal AS line FROM chunks QUALIFY lead(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) IS NOT NULL",
}


@query("k1_core_tables", f"WITH {O.CHUNKS}, {O.MARKS}, {O.ACCESSES}, {O.FINDINGS}, l AS ({' UNION ALL '.join(f'''SELECT '{k}' AS name, line FROM ({v})''' for k, v in _CORE.items())}) SELECT d.name, digest, n AS rows FROM ({group_digest_sql('SELECT * FROM l', 'name')}) d JOIN (SELECT name, count(*) AS n FROM l GROUP BY name) USING (name)")
def k1(spark, d):
    """Seven core tables, overwritten in one commit after an older state, read back: rows and digest of each."""
    spans = E.chunk_spans(spark, d)
    docs = E.read(spark, d, "documents")
    tables = {
        "documents": docs.select(F.concat_ws(":", "doc_id", F.sha2("text", 256)).alias("line")),
        "chunks": spans.select(F.concat_ws(":", "document_id", "ordinal", "start", "end").alias("line")),
        "marks": E.marks(spark, d).select(F.concat_ws(":", "target_id", "action").alias("line")),
        "accesses": E.accesses(spark, d).select(F.concat_ws(":", "event_id", "target_id", "kind", "accessed_at").alias("line")),
        "messages": E.messages(spark, d).select(F.concat_ws(":", "session_id", "turn", "role", F.sha2("content", 256)).alias("line")),
        "findings": E.findings(spark, d).select(F.concat_ws(":", "page_id", "domain", "content_hash").alias("line")),
        "links": sequence_links(spans).select(F.concat_ws(":", "document_id", "source").alias("line")),
    }
    ledger = _ledger(spark)
    C.save_all(ledger, "older", {name: rows.limit(0) for name, rows in tables.items()})
    _twice(C.save_all, ledger, "import", tables)
    lines = None
    for name in tables:
        part = ledger.read(name).select(F.lit(name).alias("name"), "line")
        lines = part if lines is None else lines.union(part)
    return group_digest(lines, ["name"]).join(lines.groupBy("name").agg(F.count("*").alias("rows")), "name")


@query("l7_tables_after_delete", f"""WITH {O.CHUNKS}, {O.MARKS}, {O.ACCESSES}, {_GONE}, model AS (SELECT bool_or(('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT % 10 <= 6) AS stale FROM documents SEMI JOIN gone USING (doc_id)),
kept AS (SELECT 'documents' AS kind, doc_id, length(text)::BIGINT AS item FROM documents UNION ALL SELECT 'chunks', document_id, ordinal FROM chunks UNION ALL SELECT 'marks', target_id, length(action) FROM marks UNION ALL SELECT 'accesses', target_id, event_id FROM accesses)
SELECT kind, doc_id, item, NULL::VARCHAR AS state FROM kept WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'model', NULL, NULL, CASE WHEN stale THEN 'stale' ELSE 'fresh' END FROM model""")
def l7_tables(spark, d):
    """Documents, chunks, marks, accesses and the model's state after toxic documents are deleted."""
    ledger = _ledger(spark)
    tables = {
        "documents": E.read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("item")),
        "chunks": E.chunk_spans(spark, d).select("document_id", F.col("ordinal").cast("long").alias("item")),
        "marks": E.marks(spark, d).select("target_id", F.length("action").cast("long").alias("item")),
        "accesses": E.accesses(spark, d).select("target_id", F.col("event_id").alias("item")),
        "model": spark.range(1).select(F.lit("fresh").alias("state"), F.lit(None).cast("string").alias("reason")),
    }
    owned = {"chunks": "document_id", "marks": "target_id", "accesses": "target_id"}
    C.save_all(ledger, "import", tables)
    _twice(C.delete_documents, ledger, "forget", _toxic(spark, d), owned, H.split_name(F.col("doc_id").cast("string")) == "train")
    out = ledger.read("model").select(F.lit("model").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("item"), "state")
    for name, key in ({"documents": "doc_id"} | owned).items():
        out = out.union(ledger.read(name).select(F.lit(name), key, "item", F.lit(None).cast("string")))
    return out


@query("l2_tables_after_rebuild", f"""WITH {O.CHUNKS}, {O.embeddings('chunks', 'document_id, ordinal')}, {_GONE}, seen AS (SELECT DISTINCT user_id AS doc_id FROM events), cache AS (SELECT DISTINCT md5(text) AS h FROM chunks SEMI JOIN (SELECT doc_id AS document_id FROM labels WHERE quality = 1) USING (document_id))
SELECT document_id AS doc_id, ordinal, CASE WHEN document_id IN (FROM seen) THEN 'kept' ELSE 'missing' END AS state, md5(text) AS text_hash, md5(text) IN (FROM cache) AS reused, coalesce(len(list_filter(v, lambda x: x <> 0)), 0)::INT AS dims
FROM chunks LEFT JOIN emb USING (document_id, ordinal) WHERE document_id NOT IN (FROM gone)""")
def l2_tables(spark, d):
    """Documents and chunks after a rebuild: toxic documents go, documents that nobody accessed have lost their files, and embeddings of good documents' chunks were stored before."""
    chunks = E.chunks(spark, d).select(F.col("document_id").alias("doc_id"), "ordinal", "text", F.md5("text").alias("text_hash"))
    good = E.read(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    ledger = _ledger(spark)
    stored = chunks.join(good, "doc_id", "left_semi").select("doc_id", "ordinal", "text_hash", V.embed(F.col("text")).alias("embedding"), F.lit(False).alias("reused"))
    C.save_all(ledger, "import", {"documents": good.withColumn("state", F.lit("kept")), "chunks": stored})
    seen = E.read(spark, d, "events").select(F.col("user_id").alias("doc_id"))
    _twice(C.rebuild, ledger, "rebuild", E.read(spark, d, "documents").select("doc_id"), chunks, seen, _toxic(spark, d), V.embed(F.col("text")))
    dims = F.size(F.filter("embedding", lambda x: x != 0))
    return ledger.read("chunks").join(ledger.read("documents"), "doc_id").select("doc_id", "ordinal", "state", "text_hash", "reused", dims.alias("dims"))


@query("b10_audited_state", f"""WITH {O.MARKS}, m AS (SELECT target_id, action, action = 'suppress' AND target_id IN (SELECT target_id FROM marks WHERE action = 'promote') AS gone FROM marks),
w AS (SELECT 'attention_mark' AS kind, target_id, action AS payload FROM marks UNION ALL SELECT 'derived_memory', conv_id, left(text, 240) FROM conversations WHERE role = 'assistant')
SELECT 'mark' AS tab, target_id, action AS what, CASE WHEN gone THEN 'contradicted' END AS detail FROM m
UNION ALL SELECT 'memory', conv_id, md5(left(text, 240)), NULL FROM conversations WHERE role = 'assistant'
UNION ALL SELECT DISTINCT 'audit', target_id, 'write', md5('write:' || kind || ':' || target_id || ':' || payload) FROM w
UNION ALL SELECT DISTINCT 'audit', target_id, 'revert', md5('revert:attention_mark:' || target_id || ':' || action) FROM m WHERE gone""")
def b10_state(spark, d):
    """Marks, memories and audit events after audited writes and the revert of suppressions that a promotion contradicts."""
    ledger = _ledger(spark)
    marks = E.marks(spark, d)
    memories = E.messages(spark, d).filter("role = 'assistant'").select(F.col("session_id").alias("target_id"), F.substring("content", 1, 240).alias("text"))
    _twice(C.write_audited, ledger, "writes", marks, memories)
    up = marks.filter("action = 'promote'").select("target_id").distinct()
    _twice(C.revert_marks, ledger, "contradicted", marks.filter("action = 'suppress'").join(up, "target_id", "left_semi"))
    rows = ledger.read("marks").select(F.lit("mark").alias("tab"), "target_id", F.col("action").alias("what"), F.col("reverted_by").alias("detail"))
    rows = rows.union(ledger.read("memories").select(F.lit("memory"), "target_id", F.md5("text"), F.lit(None).cast("string")))
    return rows.union(ledger.read("audit").select(F.lit("audit"), "target_id", "event", "event_id"))


_REGION_LINES = "SELECT source || '/' || lang AS region, (document_id * 600 + ordinal) || ':' || ordinal || ':' || md5(chunks.text) || ':64' AS line FROM chunks JOIN documents ON doc_id = document_id"
_AFTER = " WHERE document_id NOT IN (FROM gone)"


def _region_rows(spark, d):
    """Chunks of a region, that is a source's documents of one language: region, id, ordinal, text_hash, v."""
    langs = E.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    rows = E.embedded_chunks(spark, d).join(langs, "document_id")
    rows = rows.select("document_id", F.concat_ws("/", "family", "lang").alias("region"), (F.col("document_id") * 600 + F.col("ordinal")).alias("id"), "ordinal", F.md5("text").alias("text_hash"), F.col("embedding").alias("v"))
    rows = written(rows, "index-rows")
    return rows, rows.join(_toxic(spark, d).withColumnRenamed("doc_id", "document_id"), "document_id", "left_anti")


@query("i2_refreshed_index", f"""WITH {O.CHUNKS}, {_GONE}, {O.embeddings('chunks', 'document_id, ordinal')}, a AS ({group_digest_sql(_REGION_LINES, 'region')}), b AS ({group_digest_sql(_REGION_LINES + _AFTER, 'region')}),
r AS (SELECT source || '/' || lang AS region, document_id * 600 + ordinal AS id, coalesce(v, [0::DOUBLE for i in range(64)]) AS v FROM chunks JOIN documents ON doc_id = document_id LEFT JOIN emb USING (document_id, ordinal) {_AFTER}),
e AS (SELECT x.region, x.id, round({O.dot('x.v', 'y.v')} + 1e-12, 6) AS score FROM r x JOIN r y ON x.region = y.region AND x.id <> y.id QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY score DESC, y.id) <= 4)
SELECT b.region, b.digest AS signature, a.digest = b.digest AS reused, coalesce(n, 0) AS entries, round(coalesce(total, 0), 4) AS total FROM b JOIN a USING (region) LEFT JOIN (SELECT region, count(*) AS n, sum(score)::DOUBLE AS total FROM e GROUP BY region) USING (region)""")
def i2_stored(spark, d):
    """The stored index after toxic documents are deleted and it is refreshed: which regions kept their entries, and the live entries."""
    whole, left = _region_rows(spark, d)
    ledger = _ledger(spark)
    X.refresh(ledger, "build", whole)
    _twice(X.refresh, ledger, "refresh", left)
    per = X.live_entries(ledger).groupBy("region").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    rows = ledger.read("signatures").join(per, "region", "left")
    return rows.select("region", "signature", (F.col("built") == "build").alias("reused"), F.coalesce("n", F.lit(0)).alias("entries"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@query("i4_stored_health", f"""WITH {O.CHUNKS}, {_GONE}, a AS ({group_digest_sql(_REGION_LINES, 'region')}), b AS ({group_digest_sql(_REGION_LINES + _AFTER, 'region')}),
n AS (SELECT (SELECT count(*) FROM a) AS ra, (SELECT count(*) FROM b) AS rb, (SELECT count(*) FROM ({_REGION_LINES})) AS ca, (SELECT count(*) FROM ({_REGION_LINES}{_AFTER})) AS cb,
 (SELECT count(*) FROM a JOIN b USING (region) WHERE a.digest <> b.digest) AS stale, (SELECT count(*) FROM a ANTI JOIN b USING (region)) AS over_)
SELECT 'region-knn/1' AS kind, 'after delete' AS moment, ra AS stored_regions, rb AS regions, ca::BIGINT AS stored_rows, cb::BIGINT AS rows, 64 AS stored_dimension, 64 AS dimension, stale, 0::BIGINT AS missing, over_ AS left_over, stale + over_ = 0 AS healthy FROM n
UNION ALL SELECT 'region-knn/1', 'after refresh', rb, rb, cb::BIGINT, cb::BIGINT, 64, 64, 0, 0, 0, true FROM n""")
def i4_stored(spark, d):
    """Health of the stored index against the chunks that are left, before and after its refresh."""
    whole, left = _region_rows(spark, d)
    ledger = _ledger(spark)
    X.refresh(ledger, "build", whole)
    before = X.health(ledger, left).withColumn("moment", F.lit("after delete"))
    before = written(before, "health")
    X.refresh(ledger, "refresh", left)
    return before.unionByName(X.health(ledger, left).withColumn("moment", F.lit("after refresh")))
