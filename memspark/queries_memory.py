"""Queries on the route map, lexical regions, link sets, snippets, small codecs and clamps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import hashing as H
from memspark.functions import text as T
from memspark.operators import knowledge as K
from memspark.operators import routemap as R
from memspark.operators.graph import sequence_links
from memspark.plans import entities as E
from memspark.registry import query


def docs(spark, d):
    return E.read(spark, d, "documents")


def _budget_sql(budget: int) -> str:
    entry = "json_object('region_id', region_id, 'label', left(label, 18), 'summary', {}, 'filters', {})::VARCHAR"
    rows = "SELECT 'part-' || lpad(p_partkey::VARCHAR, 9, '0') AS region_id, p_name AS label, p_type || ' of brand ' || p_brand || ' in size ' || p_size || ' and nothing besides' AS summary, p_brand, p_size FROM part"
    whole = entry.format("left(summary, 64)", "json_object('brand_name', p_brand, 'size', p_size::VARCHAR)")
    shrunk = entry.format("left(left(summary, 64), greatest(1, length(left(summary, 64)) - 8 * step)::INT)", "CASE WHEN step > 0 THEN json_object('brand_na', left(p_brand, 12)) ELSE json_object('brand_name', p_brand, 'size', p_size::VARCHAR) END")
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY region_id)::INT AS position FROM ({rows})),
w AS (SELECT position, {whole} AS entry FROM r), p AS (SELECT *, sum(strlen(entry) + 1) OVER (ORDER BY position) + 13 <= {budget} AS fits FROM w),
s AS (SELECT position, step, {shrunk} AS entry FROM r, range(0, 9) t(step) WHERE position <= 3),
z AS (SELECT step, sum(strlen(entry) + 1) + 13 AS bytes FROM s GROUP BY step), c AS (SELECT coalesce(min(step) FILTER (bytes <= {budget}), max(step)) AS step FROM z)
SELECT position, entry FROM p WHERE fits AND position > 3 UNION ALL SELECT position, entry FROM s JOIN c USING (step)"""


def _parts(spark, d):
    p = E.read(spark, d, "part")
    size = F.col("p_size").cast("string")
    summary = F.concat("p_type", F.lit(" of brand "), "p_brand", F.lit(" in size "), size, F.lit(" and nothing besides"))
    return p.select(F.concat(F.lit("part-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("region_id"), F.col("p_name").alias("label"), summary.alias("summary"), F.create_map(F.lit("brand_name"), F.col("p_brand"), F.lit("size"), size).alias("filters"))


@query("o5_byte_budget_map", _budget_sql(2048))
def o5(spark, d):
    return R.byte_budget(_parts(spark, d))


@query("o5_shrunk_map", _budget_sql(380))
def o5_small(spark, d):
    """A budget that three entries only meet once shrunk."""
    return R.byte_budget(_parts(spark, d), 380)


@query("c2_lexical_regions", f"""WITH t AS (SELECT doc_id, list_filter({O.tokens('text')}, lambda w: w NOT IN {O.STOP}) AS t, {O.tokens('text')} AS every FROM documents), w AS (SELECT doc_id, unnest(t) AS term FROM t),
seeds AS (SELECT term AS seed, row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, term) AS k FROM w GROUP BY term QUALIFY k <= 5),
near AS (SELECT seed, k, term, row_number() OVER (PARTITION BY seed ORDER BY n DESC, term) AS r FROM (SELECT seed, k, term, count(*) AS n FROM w JOIN (SELECT DISTINCT w.doc_id, seed, k FROM w JOIN seeds ON w.term = seed) USING (doc_id) WHERE term <> seed GROUP BY ALL) QUALIFY r <= 3),
terms AS (SELECT k, seed AS term FROM seeds UNION ALL SELECT k, term FROM near), specs AS (SELECT 'region-' || k AS region_id, list(DISTINCT term) AS terms FROM terms GROUP BY k)
SELECT doc_id AS document_id, max((len(list_filter(terms, lambda x: list_contains(every, x)))::INT, region_id))[2] AS region_id, max(len(list_filter(terms, lambda x: list_contains(every, x))))::INT AS score FROM t, specs GROUP BY doc_id""")
def c2(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("document_id"), "text")
    return R.assign_lexical(rows, R.lexical_specs(rows))


@query("u7_map_fallback", """WITH c AS (SELECT user_id AS query, event_type AS region, count(*)::BIGINT AS n FROM events GROUP BY ALL), i AS (SELECT query, region, greatest(n - 9, 0) AS score FROM c WHERE region IN ('view', 'click')),
a AS (SELECT query, region, score, 'index' AS reason, CASE WHEN score > 0 THEN 0 ELSE 2 END AS tier FROM i UNION ALL SELECT query, region, n, 'fallback', 1 FROM c WHERE region NOT IN ('view', 'click')),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, region)::INT AS rank FROM a QUALIFY rank <= 3)
SELECT query, region, score, reason, rank FROM r QUALIFY tier < 2 OR min(tier) OVER (PARTITION BY query) = 2""")
def u7(spark, d):
    """Event types stand for regions; views and clicks are those of the index."""
    c = E.read(spark, d, "events").groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("region")).agg(F.count("*").alias("n"))
    index = c.filter(F.col("region").isin("view", "click")).select("query", "region", F.greatest(F.col("n") - 9, F.lit(0)).cast("long").alias("score"))
    return R.with_fallback(index, c.select("query", "region", F.col("n").alias("score")), 3)


@query("c1_embedding_reuse", f"WITH {O.CHUNKS}, known AS (SELECT DISTINCT md5(text) AS h FROM chunks WHERE document_id % 3 = 0) SELECT family, count(*) FILTER (h IS NOT NULL) AS reused, count(*) FILTER (h IS NULL) AS embedded FROM chunks LEFT JOIN known ON md5(text) = h GROUP BY family")
def c1(spark, d):
    """What a batch takes from the cache (chunks of every third document) and what it embeds anew; only digests are joined."""
    c = E.chunks(spark, d).select("family", "document_id", F.md5("text").alias("h"))
    known = c.filter("document_id % 3 = 0").select("h").distinct().withColumn("known", F.lit(True))
    return c.join(known, "h", "left").groupBy("family").agg(F.count("known").alias("reused"), F.count_if(F.col("known").isNull()).alias("embedded"))


_AGENT = "agent AS (SELECT doc_id AS document_id, 0 AS source, 1 + (doc_id % 3)::INT AS target, 1.0::DOUBLE AS score, 'agent' AS actor FROM documents WHERE doc_id % 4 = 0)"


def _agent(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).filter(i % 4 == 0).select(i.alias("document_id"), F.lit(0).alias("source"), (F.lit(1) + i % 3).cast("int").alias("target"), F.lit(1.0).alias("score"), F.lit("agent").alias("actor"))


@query("g9_agent_links", f"WITH {_AGENT} SELECT document_id, source, target, score, actor FROM agent")
def g9(spark, d):
    """Links that a user's agent has written are edges of full score."""
    return _agent(spark, d)


@query("u2_link_union", f"WITH {O.CHUNKS}, {_AGENT}, m AS (SELECT document_id, ordinal AS source, (ordinal + 1)::INT AS target, 0.9::DOUBLE AS score, 'builder' AS actor FROM chunks QUALIFY lead(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) IS NOT NULL) SELECT document_id, source, target, arg_min(score, actor) AS score, min(actor) AS actor FROM (SELECT * FROM m UNION ALL SELECT * FROM agent) GROUP BY ALL")
def u2(spark, d):
    """Built and agent links together, one a pair; the agent's goes first."""
    built = sequence_links(E.chunk_spans(spark, d)).select("document_id", "source", "target", "score", F.lit("builder").alias("actor"))
    both = built.unionByName(_agent(spark, d))
    return both.groupBy("document_id", "source", "target").agg(F.min_by("score", "actor").alias("score"), F.min("actor").alias("actor"))


_KIND = "CASE doc_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.44 ELSE 0.45 END::DOUBLE"


@query("g12_visual_snapshot", f"""WITH l AS (SELECT doc_id, {_KIND} AS weight FROM documents) SELECT 'chunk:' || doc_id AS a, 'document:' || doc_id AS b, 1.0::DOUBLE AS weight, 'contains' AS kind FROM documents
UNION ALL SELECT 'chunk:' || doc_id, 'chunk:' || (doc_id + 1), weight, 'link' FROM l WHERE weight >= 0.45 UNION ALL SELECT 'region:' || source, 'document:' || doc_id, 1.0, 'member' FROM documents""")
def g12(spark, d):
    """Edges that a map shows: memberships, containment and links of weight 0.45 or more."""
    i = F.col("doc_id")
    weight = F.when(i % 3 == 0, 0.9).when(i % 3 == 1, 0.44).otherwise(0.45)
    name = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    links = docs(spark, d).select(name("chunk", i).alias("a"), name("chunk", i + 1).alias("b"), weight.alias("weight"), F.lit("link").alias("kind")).filter("weight >= 0.45")
    inside = docs(spark, d).select(name("chunk", i), name("document", i), F.lit(1.0), F.lit("contains"))
    member = docs(spark, d).select(name("region", F.col("source")), name("document", i), F.lit(1.0), F.lit("member"))
    return links.union(inside).union(member)


@query("n12_open_excerpt", f'WITH {O.CHUNKS} SELECT c.document_id, c.ordinal, md5(substring(d.text, greatest(c.start - 140, 0) + 1, least(c."end" + 140, length(d.text)) - greatest(c.start - 140, 0))) AS excerpt_digest FROM chunks c JOIN documents d ON d.doc_id = c.document_id')
def n12(spark, d):
    """Each chunk with 140 characters on either side, cut while the document is at hand."""
    whole = docs(spark, d).select(F.col("doc_id").alias("document_id"), "text")
    c = whole.select("document_id", "text", F.explode(T.chunk_structs(F.col("text"), False)).alias("c"))
    return c.select("document_id", "c.ordinal", F.md5(T.excerpt(F.col("text"), F.col("c.start"), F.col("c.end"), 140)).alias("excerpt_digest"))


@query("x5_action_target", "SELECT conv_id, arg_max(turn, (length(text) + CASE WHEN role = 'user' THEN 100 ELSE 0 END, turn)) AS turn FROM conversations GROUP BY conv_id")
def x5(spark, d):
    """The snippet that an action without a target falls on: largest score and hotness together."""
    heat = F.length("content") + F.when(F.col("role") == "user", 100).otherwise(0)
    return E.messages(spark, d).groupBy(F.col("session_id").alias("conv_id")).agg(F.max_by("turn", F.struct(heat, "turn")).alias("turn"))


@query("x6_snippets", "SELECT conv_id, turn, 'memory://chat_message/' || conv_id || ':' || turn AS source_ref, left(text, 360) AS excerpt FROM conversations")
def x6(spark, d):
    m = E.messages(spark, d)
    return m.select(F.col("session_id").alias("conv_id"), "turn", F.concat(F.lit("memory://chat_message/"), F.concat_ws(":", "session_id", "turn")).alias("source_ref"), F.substring("content", 1, 360).alias("excerpt"))


@query("aj10_snippet_refs", "SELECT conv_id, list_sort(list(DISTINCT role || ':' || (turn % 3))) AS refs, bool_or(role = 'assistant') AS grounded FROM conversations GROUP BY conv_id")
def aj10(spark, d):
    """Distinct references are aggregated, not a session's snippets."""
    m = E.messages(spark, d)
    return m.groupBy(F.col("session_id").alias("conv_id")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "role", F.col("turn") % 3))).alias("refs"), F.bool_or(F.col("role") == "assistant").alias("grounded"))


@query("aj2_span_lookup", """SELECT event_id, list_filter([{s: 0, e: 10, v: event_type}, {s: 10, e: 25, v: 'rest'}], lambda x: x.s <= event_id % 30 AND event_id % 30 < x.e)[1].v AS value FROM events""")
def aj2(spark, d):
    """A span array kept as JSON is decoded and the span that holds a place is looked up."""
    body = F.concat(F.lit('[{"start":0,"end":10,"value":"'), "event_type", F.lit('"},{"start":10,"end":25,"value":"rest"}]'))
    spans = F.from_json(body, "array<struct<start:int,end:int,value:string>>")
    at = F.col("event_id") % 30
    return E.read(spark, d, "events").select("event_id", F.get(F.filter(spans, lambda x: (x["start"] <= at) & (at < x["end"])), F.lit(0))["value"].alias("value"))


@query("aj5_context_values", "SELECT event_id, list_sort(list_distinct([event_type, 'u' || (user_id % 3), 'view'])) AS vals FROM events")
def aj5(spark, d):
    """Values of several keys, split, sorted, each once."""
    many = K.split_values(F.concat_ws(" , ", "event_type", F.concat(F.lit("u"), F.col("user_id") % 3)))
    return E.read(spark, d, "events").select("event_id", F.array_sort(F.array_distinct(F.flatten(F.array(many, F.array(F.lit("view")))))).alias("vals"))


@query("aj7_rebase_paths", "SELECT page_id, '{\"p\":[\"/new/store/' || page_id || '\",\"x /old/store\"]}' AS body FROM pages")
def aj7(spark, d):
    """Strings that begin with the old folder move to the new one, at any depth of the JSON text."""
    body = F.concat(F.lit('{"p":["/old/store/'), "page_id", F.lit('","x /old/store"]}'))
    return E.read(spark, d, "pages").select("page_id", F.regexp_replace(body, '"/old/store(?=[/"])', '"/new/store').alias("body"))


@query("f21_confidence_bands", "SELECT event_id, CASE WHEN value / 100 >= 0.88 THEN 'high' WHEN value / 100 >= 0.78 THEN 'medium' ELSE 'low' END AS link_band, CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.65 THEN 'medium' ELSE 'low' END AS inspection_band FROM events")
def f21(spark, d):
    s = F.col("value") / 100
    return E.read(spark, d, "events").select("event_id", T.confidence_band(s).alias("link_band"), T.confidence_band(s, 0.85, 0.65).alias("inspection_band"))


@query("f22_region_labels", f"""WITH {O.CHUNKS}, w AS (SELECT family, unnest({O.tokens('text')}) AS term FROM chunks), n AS (SELECT family, term, count(*) AS n FROM w WHERE term NOT IN {O.STOP} GROUP BY family, term), c AS (SELECT family, term, row_number() OVER (PARTITION BY family ORDER BY n DESC, term) AS r FROM n)
SELECT family, upper(family[1]) || family[2:] || ': ' || coalesce(string_agg(term, ' / ' ORDER BY r), 'general') AS label FROM c WHERE r <= 3 GROUP BY family""")
def f22(spark, d):
    from memspark.operators.regions import top_terms

    t = top_terms(E.chunks(spark, d), ["family"]).groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " / ").alias("terms"))
    name = F.concat(F.upper(F.substring("family", 1, 1)), F.expr("substring(family, 2)"))
    return t.select("family", F.concat(name, F.lit(": "), F.coalesce("terms", F.lit("general"))).alias("label"))


@query("v4_clamped_scores", "SELECT event_id, round(greatest(least(value / 100 - 0.5, 0.55), -0.45), 6) AS boost, round(greatest(least(value / 100 - 0.5, 0.34), -0.28), 6) AS context, round(greatest(least(value / 100 - 0.5, 0.18), -0.18), 6) AS source, greatest(value / 100 - 0.5, 0.001) AS score FROM events")
def v4(spark, d):
    x = F.col("value") / 100 - 0.5
    clamp = lambda low, high: F.round(F.greatest(F.least(x, F.lit(high)), F.lit(low)), 6)
    return E.read(spark, d, "events").select("event_id", clamp(-0.45, 0.55).alias("boost"), clamp(-0.28, 0.34).alias("context"), clamp(-0.18, 0.18).alias("source"), F.greatest(x, F.lit(0.001)).alias("score"))


@query("v5_guarded_ratio", "SELECT source, CASE WHEN count(quality) = 0 THEN 0 ELSE round(sum(quality)::DOUBLE / count(quality), 4) END AS ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def v5(spark, d):
    rows = docs(spark, d).select("doc_id", "source").join(E.read(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.coalesce(F.try_divide(F.sum("quality"), F.count("quality")), F.lit(0.0)), 4).alias("ratio"))


@query("w8_reciprocal_rank", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) SELECT user_id, round(coalesce(1.0::DOUBLE / min(rank) FILTER (event_type = 'purchase'), 0), 6) AS reciprocal_rank FROM r GROUP BY user_id")
def w8(spark, d):
    """Hits are events by value; purchases stand for relevant ones."""
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = E.read(spark, d, "events").select("user_id", "event_type", F.row_number().over(order).alias("rank"))
    return ranked.groupBy("user_id").agg(F.round(F.coalesce(F.lit(1.0) / F.min(F.when(F.col("event_type") == "purchase", F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"))


@query("a23_memory_summary", f"WITH {O.CHUNKS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT label) FROM embeddings) AS regions, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM chunks GROUP BY document_id)) AS links")
def a23(spark, d):
    """Four one-row aggregates side by side; links are those of chunk sequences."""
    n = F.size(T.chunk_structs(F.col("text"), False))
    sizes = docs(spark, d).select(n.alias("n")).agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("chunks"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).cast("long").alias("links"))
    regions = E.read(spark, d, "embeddings").agg(F.countDistinct("label").alias("regions"))
    return sizes.crossJoin(regions).select("documents", "chunks", "regions", "links")  # one row each


#: Bits of a 32-bit float from its exponent and mantissa, which doubles hold exactly.
_BITS = "CASE WHEN x = 0 THEN 0 ELSE (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END) + (e + 127) * 8388608 + ((abs(x) / pow(2.0, e) - 1) * 8388608)::BIGINT END"
_EXPONENT = "CASE WHEN x = 0 THEN 0 WHEN pow(2.0, floor(log2(abs(x)))) > abs(x) THEN floor(log2(abs(x)))::BIGINT - 1 WHEN pow(2.0, floor(log2(abs(x))) + 1) <= abs(x) THEN floor(log2(abs(x)))::BIGINT + 1 ELSE floor(log2(abs(x)))::BIGINT END"


@query("h2_vector_hash", f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT vec_id, i, {_BITS} AS bits FROM (SELECT *, {_EXPONENT} AS e FROM x)),
v AS (SELECT vec_id, list(bits ORDER BY i) AS l FROM b GROUP BY vec_id)
SELECT vec_id, lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, [((l[(j // 4 + 1)::INT] >> (8 * (j % 4))::INT) & 255)::HUGEINT for j in range(4 * len(l))]), lambda h, y: (xor(h, y) * 1099511628211) % 18446744073709551616)::UBIGINT), 16, '0')) AS digest FROM v""")
def h2(spark, d):
    return E.read(spark, d, "embeddings").select("vec_id", H.fnv1a_floats("embedding").alias("digest"))


@query("j19_artifact_documents", "SELECT a.id AS artifact, d.doc_id, d.lang FROM (SELECT 'artifact:' || source AS id, source FROM documents GROUP BY source HAVING count(*) > 1) a JOIN documents d USING (source)")
def j19(spark, d):
    artifacts = docs(spark, d).groupBy("source").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("artifact:"), "source").alias("artifact"), "source")
    return docs(spark, d).select("doc_id", "lang", "source").join(artifacts, "source").select("artifact", "doc_id", "lang")


@query("l6_saved_views", "SELECT user_id, count(DISTINCT event_type) AS members, arg_max(event_type, (ts, event_id)) AS newest FROM events GROUP BY user_id")
def l6(spark, d):
    """Collections: a user's saved items (event types), one row an item, and the newest."""
    e = E.read(spark, d, "events")
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("members"), F.max_by("event_type", F.struct("ts", "event_id")).alias("newest"))


@query("l8_library_snapshot", "SELECT 'documents' AS part, source AS name, count(*) AS items FROM documents GROUP BY source UNION ALL SELECT 'pages', NULL, count(*) FROM pages UNION ALL SELECT 'sessions', role, count(*) FROM conversations GROUP BY role")
def l8(spark, d):
    a = docs(spark, d).groupBy("source").count().select(F.lit("documents").alias("part"), F.col("source").alias("name"), F.col("count").alias("items"))
    b = E.read(spark, d, "pages").agg(F.count("*").alias("n")).select(F.lit("pages"), F.lit(None).cast("string"), "n")
    c = E.messages(spark, d).groupBy("role").count().select(F.lit("sessions"), "role", "count")
    return a.union(b).union(c)


@query("x19_visibility", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'private' WHEN source = 'src2' THEN 'team_shared' ELSE 'public' END AS visibility, list_filter([CASE WHEN lang <> 'en' THEN 'foreign_language' END, CASE WHEN n_chars < 200 THEN 'short_text' END], lambda x: x IS NOT NULL) AS labels FROM documents")
def x19(spark, d):
    labels = F.array_compact(F.array(F.when(F.col("lang") != "en", "foreign_language"), F.when(F.col("n_chars") < 200, "short_text")))
    return docs(spark, d).select("doc_id", F.coalesce(E.lookup(F.col("source"), {"src1": "private", "src2": "team_shared"}), F.lit("public")).alias("visibility"), labels.alias("labels"))
