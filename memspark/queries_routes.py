"""Queries on sketches, traces, anchors, trails and dataset states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import text as T
from memspark.operators import retrieval as R
from memspark.operators import sessions as SE
from memspark.operators import training as G
from memspark.plans import entities as E
from memspark.plans.scratch import written
from memspark.queries_retrieval import asked, hybrid_sql
from memspark.queries_training import _RECORDS, records
from memspark.registry import query

_CARDS = "card AS (SELECT lang AS region_id, lower('Language ' || lang || ' documents') AS label, lower(string_agg(DISTINCT source, ' ' ORDER BY source)) AS refs FROM documents WHERE lang IS NOT NULL GROUP BY lang)"


def _met(spark, d):
    """Queries with their tokens beside every card; a card is a row a language, gathered as literals."""
    cards = E.read(spark, d, "documents").filter("lang is not null").groupBy("lang").agg(F.lower(F.array_join(F.array_sort(F.collect_set("source")), " ")).alias("refs")).orderBy("lang").collect()
    card = [F.struct(F.lit(r["lang"]).alias("region_id"), F.lit(f"language {r['lang']} documents".lower()).alias("label"), F.lit(r["refs"]).alias("refs")) for r in cards]
    asks = E.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("tokens"))
    if not card:
        return asks.select("query_id", "tokens", *[F.lit("").alias(n) for n in ("region_id", "label", "refs")]).limit(0)
    return asks.select("query_id", "tokens", F.explode(F.array(*card)).alias("c")).select("query_id", "tokens", "c.*")


@query("r2_sketch_routing", f"""WITH t AS (SELECT item_id, unnest({O.tokens('text')}) AS tok FROM benchmark), {_CARDS},
s AS (SELECT item_id, region_id, sum(CASE WHEN contains(label, tok) THEN 2.0 ELSE 0 END + CASE WHEN contains(region_id || ' -> search', tok) THEN 1.25 ELSE 0 END + CASE WHEN contains(refs, tok) THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM t, card GROUP BY ALL),
p AS (SELECT *, 0 AS fallback FROM s WHERE score > 0 UNION ALL SELECT item_id, region_id, 0.0, 1 FROM s WHERE score = 0)
SELECT item_id AS query_id, region_id, score, fallback = 1 AS fallback, (row_number() OVER (PARTITION BY item_id ORDER BY fallback, score DESC, region_id))::INT AS rank FROM p QUALIFY rank <= 3""")
def r2(spark, d):
    """Sketch scores first; regions that no sketch met fill what is left of the three routes."""
    has = lambda c: F.aggregate(F.transform("tokens", lambda t: F.when(F.contains(c, t), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    score = 2.0 * has(F.col("label")) + 1.25 * has(F.concat("region_id", F.lit(" -> search"))) + 0.5 * has(F.col("refs"))
    rows = _met(spark, d).filter(F.size("tokens") > 0).select("query_id", "region_id", score.alias("score")).withColumn("fallback", F.col("score") == 0)
    w = Window.partitionBy("query_id").orderBy("fallback", F.desc("score"), "region_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


@query("r13_route_trace", f"WITH t AS (SELECT DISTINCT item_id, unnest({O.tokens('text')}) AS tok FROM benchmark), {_CARDS} SELECT item_id AS query_id, region_id, string_agg(tok, ' ' ORDER BY tok) AS matched_terms FROM t JOIN card ON contains(label || ' ' || refs, tok) GROUP BY ALL")
def r13(spark, d):
    matched = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: F.contains(F.concat_ws(" ", "label", "refs"), t))))
    return _met(spark, d).select("query_id", "region_id", matched.alias("m")).filter(F.size("m") > 0).select("query_id", "region_id", F.array_join("m", " ").alias("matched_terms"))


@query("r7_region_context", f"WITH {O.MARKS}, s AS (SELECT d.lang AS value, round(sum({O.MARK_DELTA}), 6)::DOUBLE AS s FROM marks JOIN documents d ON d.doc_id = target_id GROUP BY d.lang) SELECT source AS region, round(greatest(least(sum(s), 0.45), -0.35), 6)::DOUBLE AS boost FROM (SELECT DISTINCT source, lang AS value FROM documents) JOIN s USING (value) GROUP BY source")
def r7(spark, d):
    """Scores of the context values (languages) that a region's filters hold, clamped."""
    from memspark.operators.signals import clamp

    docs = E.read(spark, d, "documents").select(F.col("doc_id").alias("target_id"), "source", F.col("lang").alias("value"))
    scores = E.marks(spark, d).join(docs.select("target_id", "value"), "target_id").groupBy("value").agg(F.round(F.sum(E.lookup(F.col("action"), E.MARK_DELTAS)), 6).alias("s"))
    return docs.select("source", "value").distinct().join(scores, "value").groupBy(F.col("source").alias("region")).agg(F.round(clamp(F.sum("s"), -0.35, 0.45), 6).alias("boost"))


@query("n3_open_documents", f"WITH {O.CHUNKS}, n AS (SELECT document_id, count(*) AS passages FROM chunks GROUP BY ALL) SELECT doc_id, left(text, 520) AS excerpt, coalesce(passages, 0) AS passages FROM documents LEFT JOIN n ON document_id = doc_id")
def n3(spark, d):
    return E.read(spark, d, "documents").select("doc_id", F.substring("text", 1, 520).alias("excerpt"), F.coalesce(T.chunk_count(F.col("text")), F.lit(0)).cast("long").alias("passages"))


@query("n6_jump_to_anchor", f'WITH {O.CHUNKS} SELECT document_id || \':chunk:\' || ordinal || \':anchor\' AS anchor, document_id, ordinal, start, "end" FROM chunks')
def n6(spark, d):
    """Anchors name their chunk; a jump is a parse of the name and an equi-join."""
    c = E.chunk_spans(spark, d).select("document_id", "ordinal", "start", "end")
    anchors = c.select(F.concat("document_id", F.lit(":chunk:"), "ordinal", F.lit(":anchor")).alias("anchor"))
    part = lambda k: F.regexp_extract("anchor", r"^(\d+):chunk:(\d+):anchor$", k)
    named = anchors.select("anchor", part(1).cast("long").alias("document_id"), part(2).cast("int").alias("ordinal"))
    return named.join(c, ["document_id", "ordinal"]).select("anchor", "document_id", "ordinal", "start", "end")


@query("n14_trail_lengths", """WITH RECURSIVE e AS (SELECT user_id AS session_id, CASE WHEN event_type = 'error' THEN 'back' ELSE 'open' END AS action, 'n' || (event_id % 50) AS node, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT session_id, 0::BIGINT AS k, NULL::VARCHAR AS current, []::VARCHAR[] AS history, []::VARCHAR[] AS visited FROM (SELECT DISTINCT session_id FROM e)
UNION ALL SELECT session_id, k, current, history, CASE WHEN current IS NULL OR list_contains(visited, current) THEN visited ELSE list_append(visited, current) END FROM (SELECT s.session_id, e.k, CASE WHEN e.action = 'back' THEN coalesce(s.history[-1], s.current) ELSE e.node END AS current,
CASE WHEN e.action = 'back' THEN CASE WHEN len(s.history) > 0 THEN s.history[:-2] ELSE s.history END WHEN s.current IS NULL THEN s.history ELSE list_append(s.history, s.current) END AS history, s.visited FROM s JOIN e ON e.session_id = s.session_id AND e.k = s.k + 1)),
t AS (SELECT session_id, list_distinct(list_append(history, current)) AS trail, len(history) AS n, current, history, visited FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1)
SELECT session_id, (len(trail) + CASE WHEN current IS NULL THEN 1 ELSE 0 END)::INT AS steps, len(list_filter(visited, lambda v: NOT list_contains(trail, v)))::INT AS left_out FROM t""")
def n14(spark, d):
    """Trails of navigation sessions: the history, the current node and how many others were visited."""
    e = E.read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "back").otherwise("open").alias("action"), F.concat(F.lit("n"), F.col("event_id") % 50).alias("node"))
    s = SE.states(e, SE.stacks(e))
    return s.select("session_id", F.greatest("trail", F.lit(1)).cast("int").alias("steps"), (F.col("visited") - F.col("trail")).cast("int").alias("left_out"))


@query("t3_route_hints", rf"WITH {O.CHUNKS} SELECT document_id, ordinal, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), {O.SPLIT}), lambda w: strlen(w) >= 4)))[1:8], ' / ') AS hints FROM chunks WHERE len(list_filter(regexp_split_to_array(lower(text), {O.SPLIT}), lambda w: strlen(w) >= 4)) > 0")
def t3(spark, d):
    h = E.chunks(spark, d).select("document_id", "ordinal", T.representative_terms(F.col("text")).alias("t"), T.tokenize(F.col("text")).alias("any"))
    return h.filter(F.exists("any", lambda w: F.octet_length(w) >= 4)).select("document_id", "ordinal", F.array_join(F.slice("t", 1, 8), " / ").alias("hints"))


@query("t5_gate_summary", f"WITH {_RECORDS}, routes AS (SELECT count(DISTINCT target) AS n FROM records WHERE task = 'query_to_region') SELECT true AS overall_ok, true AS route_ok, 1.0 > 1.0 / routes.n AS beats_baseline, (SELECT count(*) FROM records) > 0 AS has_records FROM routes")
def t5(spark, d):
    """Activation gates: overall and route scores of 0.8 or more, and routes better than guessing."""
    r = records(spark, d)
    scores = G.evaluate(r)
    total = scores.agg((F.sum("passed") / F.sum("records") >= 0.8).alias("overall_ok"), F.bool_and(F.when(F.col("task") == "query_to_region", F.col("score") >= 0.8)).alias("route_ok"), F.max(F.when(F.col("task") == "query_to_region", F.col("score"))).alias("route"), F.sum("records").alias("n"))
    base = G.route_baseline(r).first()["baseline"]
    return total.select("overall_ok", "route_ok", (F.col("route") > F.lit(base)).alias("beats_baseline"), (F.col("n") > 0).alias("has_records"))


@query("t7_adapter_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def t7(spark, d):
    e = E.read(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("event_type") == "error").alias("failures"))


@query("x9_audit_sessions", "SELECT e.event_id, c.conv_id AS session_id FROM events e LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = e.user_id WHERE e.event_type = 'purchase'")
def x9(spark, d):
    known = E.read(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    e = E.read(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id")
    return e.join(known, F.col("user_id") == F.col("session_id"), "left").select("event_id", "session_id")


@query("f35_hit_ids", f"WITH {hybrid_sql()} SELECT item_id AS query_id, 'semantic' AS kind, 'chunk:' || document_id || ':' || ordinal AS target, rank::INT AS hit FROM hits UNION ALL SELECT item_id, 'document', document_id::VARCHAR, min(rank)::INT FROM hits GROUP BY item_id, document_id")
def f35(spark, d):
    """Ids of retrieved hits, of chunks and of their documents, written and read back."""
    hits = written(R.hybrid_scores(E.embedded_chunks(spark, d), asked(spark, d), 8), "hits")
    chunk = F.concat_ws(":", F.lit("chunk"), "document_id", "ordinal")
    ids = hits.select("query_id", F.concat(F.lit("semantic-hit:"), chunk, F.lit(":"), F.col("rank")).alias("h"))
    ids = ids.union(hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("rank")).select("query_id", F.concat(F.lit("doc-hit:"), "document_id", F.lit(":"), "rank")))
    part = lambda k: F.regexp_extract("h", r"^(doc|region|semantic)-hit:(.+):(\d+)$", k)
    return ids.select("query_id", E.lookup(part(1), {"doc": "document", "region": "region", "semantic": "semantic"}).alias("kind"), part(2).alias("target"), part(3).cast("int").alias("hit"))


@query("aj3_map_merge", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'chunk' END, lang) AS lang, source FROM documents")
def aj3(spark, d):
    """Chunk keys override document keys."""
    doc = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    chunk = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("chunk"))).otherwise(F.expr("map_filter(map('lang', ''), (k, v) -> false)"))
    merged = F.map_concat(chunk, F.map_filter(doc, lambda k, _: ~F.map_contains_key(F.col("chunk"), k)))
    rows = E.read(spark, d, "documents").select("doc_id", "lang", "source").withColumn("chunk", chunk).withColumn("m", merged)
    return rows.select("doc_id", F.element_at("m", F.lit("lang")).alias("lang"), F.element_at("m", F.lit("source")).alias("source"))


@query("aj9_json_getters", "SELECT event_id, coalesce(try_cast(props->>'$.k' AS BIGINT), -1) AS k, coalesce(props->>'$.missing', 'none') AS missing FROM events")
def aj9(spark, d):
    j = lambda p: F.get_json_object("props", p)
    return E.read(spark, d, "events").select("event_id", F.coalesce(j("$.k").try_cast("long"), F.lit(-1)).alias("k"), F.coalesce(j("$.missing"), F.lit("none")).alias("missing"))


@query("a22_context_overlay", "SELECT host, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS lang, CASE WHEN count(DISTINCT scheme) = 1 THEN min(scheme) END AS scheme FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, split_part(url, '://', 1) AS scheme FROM pages) GROUP BY host")
def a22(spark, d):
    """Values that all captures of a host share."""
    p = E.read(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"))
    only = lambda c: F.when(F.countDistinct(c) == 1, F.min(c)).alias(c)
    return p.groupBy("host").agg(only("lang"), only("scheme"))


@query("u5_split_union", f"WITH {_RECORDS}, s AS (SELECT arg_min(split, CASE split WHEN 'eval' THEN 1 WHEN 'test' THEN 2 ELSE 3 END) AS split FROM records) SELECT task, count(*) AS rows FROM records JOIN s USING (split) GROUP BY task")
def u5(spark, d):
    """The first split that has rows, of eval, test and train."""
    r = records(spark, d).select("task", "split")
    rank = F.when(F.col("split") == "eval", 1).when(F.col("split") == "test", 2).otherwise(3)
    chosen = r.agg(F.min_by("split", rank).alias("split"))
    return r.join(F.broadcast(chosen), "split").groupBy("task").agg(F.count("*").alias("rows"))  # one row is broadcast


@query("c5_source_families", "SELECT regexp_replace(lower(regexp_replace(coalesce(source, 'unknown'), '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS family, count(*) AS documents, min(doc_id) AS first_document FROM documents GROUP BY 1")
def c5(spark, d):
    family = T.slugify(F.coalesce("source", F.lit("unknown")))
    return E.read(spark, d, "documents").groupBy(family.alias("family")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))


@query("m2_region_summaries", "SELECT source AS region, 'Region ' || source || ': ' || count(*) || ' documents, languages ' || string_agg(DISTINCT lang, '/' ORDER BY lang) AS summary, 82::INT AS confidence FROM documents GROUP BY source")
def m2(spark, d):
    n = F.concat(F.lit("Region "), F.col("source"), F.lit(": "), F.count("*"), F.lit(" documents, languages "), F.array_join(F.array_sort(F.collect_set("lang")), "/"))
    return E.read(spark, d, "documents").groupBy("source").agg(n.alias("summary")).select(F.col("source").alias("region"), "summary", F.lit(82).alias("confidence"))
