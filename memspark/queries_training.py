"""Queries on training records, gates and generic relational smoke (T, A, K rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import privacy as S
from memspark.operators import training as T
from memspark.operators.digests import group_digest, group_digest_sql
from memspark.plans import entities as E
from memspark.registry import query

_RECORDS = rf"""{O.CHUNKS}, trainable AS (SELECT document_id || ':chunk:' || ordinal AS chunk_id, document_id, 'region-' || family AS region, family, text FROM chunks c WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
hinted AS (SELECT *, array_to_string(list_transform({O.words("h")}, lambda w: CASE WHEN regexp_matches(regexp_replace(w, '^[\"''`,;:)\]}}]+|[\"''`,;:)\]}}]+$', '', 'g'), '^sk-') OR regexp_matches(lower(w), 'api_key|apikey|password=|secret=|token=') THEN '[REDACTED]' ELSE w END), ' ') AS hint FROM (SELECT *, CASE WHEN length({O.collapse('text')}) > 80 THEN left({O.collapse('text')}, 80) || '...' ELSE {O.collapse('text')} END AS h FROM trainable)),
r AS (SELECT chunk_id, family, 'query_to_region' AS task, 'route_region:' || region AS target FROM hinted
UNION ALL SELECT chunk_id, family, 'query_to_source_family', 'source_family:' || family FROM hinted
UNION ALL SELECT chunk_id, family, 'query_to_tool_plan', 'memory_search;memory_open;memory_expand;cite_anchor' FROM hinted
UNION ALL SELECT chunk_id, family, 'chunk_to_semantic_address', 'region:' || region || ';document:' || document_id || ';source_family:' || family || ';anchor:' || chunk_id || ':anchor' FROM hinted
UNION ALL SELECT chunk_id, family, 'snippet_set_to_citation_boundary', 'cite_anchor_ids:' || chunk_id || ':anchor;do_not_cite_without_source_anchor' FROM hinted
UNION ALL SELECT chunk_id, family, 'web_needed_or_not', 'web_search_not_needed:source_available' FROM hinted
UNION ALL SELECT chunk_id, family, 'weak_evidence_to_next_action', 'weak_evidence:search_original_sources' FROM hinted),
records AS (SELECT *, CASE WHEN n <= 6 THEN 'train' WHEN n = 7 THEN 'eval' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(sha256(chunk_id), 1, 2))::INT % 10 AS n FROM r))"""


def records(spark, d):
    """Chunks of documents that no label suppresses; all of them, not only eight a region."""
    down = E.read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    c = E.chunks(spark, d).join(down, "document_id", "left_anti")
    chunk_id = F.concat(F.col("document_id"), F.lit(":chunk:"), F.col("ordinal"))
    return T.chunk_records(c.select(chunk_id.alias("chunk_id"), "document_id", F.concat(F.lit("region-"), "family").alias("region"), "family", "text"))


@query("t1_training_records", f"WITH {_RECORDS} SELECT chunk_id AS source_id, task, split, target FROM records")
def t1(spark, d):
    return records(spark, d).select("source_id", "task", "split", "target")


@query("t2_record_envelope", f"WITH {_RECORDS} SELECT source_id, task || ':' || split || ':' || sha256(source_id || ':Where should the library search for: ' || hint || '?:' || target) AS id FROM (SELECT r.chunk_id AS source_id, task, split, target, hint FROM records r JOIN hinted USING (chunk_id) WHERE task = 'query_to_region')")
def t2(spark, d):
    return records(spark, d).filter("task = 'query_to_region'").select("source_id", "id")


@query("a12_dataset_summary", f"WITH {_RECORDS} SELECT task, split, family, count(*) AS records FROM records GROUP BY GROUPING SETS ((task), (split), (family), ())")
def a12(spark, d):
    return T.summary(records(spark, d))


@query("a13_gate_scores", f"WITH {_RECORDS} SELECT task, count(*) AS records, count(*) AS passed, 1.0::DOUBLE AS score FROM records GROUP BY task")
def a13(spark, d):
    return T.evaluate(records(spark, d))


@query("a14_eval_coverage", f"WITH {_RECORDS}, s(name, task) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in T.EVAL_SETS.items())}) SELECT name, count(chunk_id) AS records, count(*) FILTER (contains(target, 'anchor')) AS with_anchors, count(chunk_id) > 0 AS present FROM s LEFT JOIN records USING (task) GROUP BY name")
def a14(spark, d):
    name = E.lookup(F.col("task"), {v: k for k, v in T.EVAL_SETS.items()})
    got = records(spark, d).select(name.alias("name"), "target").filter("name is not null").groupBy("name").agg(F.count("*").alias("records"), F.count_if(F.contains("target", F.lit("anchor"))).alias("with_anchors"))
    sets = spark.createDataFrame([(k,) for k in T.EVAL_SETS], "name string")
    return sets.join(got, "name", "left").select("name", F.coalesce("records", F.lit(0).cast("long")).alias("records"), F.coalesce("with_anchors", F.lit(0).cast("long")).alias("with_anchors"), F.col("records").isNotNull().alias("present"))


@query("a16_route_baseline", f"WITH {_RECORDS} SELECT count(DISTINCT target) AS targets, round(CASE WHEN count(DISTINCT target) > 1 THEN 1.0 / count(DISTINCT target) ELSE 0 END, 6)::DOUBLE AS baseline FROM records WHERE task = 'query_to_region'")
def a16(spark, d):
    return T.route_baseline(records(spark, d))


@query("p10_trainable_chunks", rf"WITH {O.CHUNKS} SELECT document_id, count(*) AS chunks FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND len(list_filter({O.words('text')}, lambda w: regexp_matches(regexp_replace(w, '^[\"''`,;:)\]}}]+|[\"''`,;:)\]}}]+$', '', 'g'), '^sk-') OR regexp_matches(lower(w), 'api_key|apikey|password=|secret=|token='))) = 0 GROUP BY document_id")
def p10(spark, d):
    down = E.read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    c = E.chunks(spark, d).select("document_id", "text").filter(~S.has_secret(F.col("text")))
    return c.select("document_id").join(down, "document_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("a29_dataset_digest", group_digest_sql("SELECT source, doc_id || ':' || sha256(text) AS line FROM documents", "source"))
def a29(spark, d):
    lines = E.read(spark, d, "documents").select("source", F.concat_ws(":", "doc_id", F.sha2("text", 256)).alias("line"))
    return group_digest(lines, ["source"])


@query("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing(spark, d):
    li = E.read(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("rel_nation_orders", "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_orders(spark, d):
    o, c, n = (E.read(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"))
