"""Further queries: predicates, context boosts, link inspection, anchors, compile and dataset steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import text as T
from memspark.functions import timefx as D
from memspark.functions import vector as V
from memspark.operators import knowledge as K
from memspark.operators.digests import group_digest, group_digest_sql
from memspark.plans import entities as E
from memspark.queries_graph import _PAIRS
from memspark.queries_training import _RECORDS, records
from memspark.registry import query

NOW = E.NOW_MS


def docs(spark, d):
    return E.read(spark, d, "documents")


@query("p5_source_predicate", "SELECT doc_id, source NOT IN ('src3', 'src4') AND NOT coalesce(toxic = 1, false) AS is_source, source IN ('src3', 'src4') AS generated, source = 'src5' AS opted_out FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def p5(spark, d):
    """Two sources stand for derived memories and artifacts, a third one opts out of training; toxic rows count as deleted."""
    toxic = E.read(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kind = F.coalesce(E.lookup(F.col("source"), {"src3": "derived_memory", "src4": "brain_artifact"}), F.lit("local_file"))
    meta = F.when(F.col("source") == "src5", F.create_map(F.lit("training_opt_out"), F.lit(" Yes "))).otherwise(F.create_map(F.lit("training_opt_out"), F.lit("no")))
    rows = docs(spark, d).select("doc_id", "source").join(toxic, "doc_id", "left")
    return rows.select("doc_id", (~K.generated(kind) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_source"), K.generated(kind).alias("generated"), K.opted_out(meta).alias("opted_out"))


@query("p16_embedding_reuse", f"WITH {O.CHUNKS} SELECT document_id, count(*) AS chunks, count(*) FILTER (document_id % 3 <> 0 AND ordinal % 2 = 0) AS reusable FROM chunks GROUP BY document_id")
def p16(spark, d):
    """A cached vector is reused if text hash, provider, dimension and version agree."""
    c = E.chunks(spark, d).select("document_id", "ordinal", F.md5("text").alias("h"), F.lit("hash").alias("provider"), F.lit(64).alias("dim"), F.lit(2).alias("version"))
    cache = c.select("document_id", "ordinal", F.col("h").alias("h2"), F.when(F.col("document_id") % 3 == 0, "other").otherwise("hash").alias("provider2"), F.lit(64).alias("dim2"), F.when(F.col("ordinal") % 2 == 0, 2).otherwise(1).alias("version2"))
    same = (F.col("h") == F.col("h2")) & (F.col("provider") == F.col("provider2")) & (F.col("dim") == F.col("dim2")) & (F.col("version") == F.col("version2"))
    return c.join(cache, ["document_id", "ordinal"]).groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(same).alias("reusable"))


@query("j16_pinned_refresh", f"WITH {O.FINDINGS} SELECT page_id, domain FROM findings WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND retrieved_at + 864000000 <= {NOW}")
def j16(spark, d):
    """Pinned findings (a good label pins the page of its id) that are due, ten days after capture."""
    pins = E.read(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    return E.findings(spark, d).filter(F.col("retrieved_at") + 10 * D.DAY <= NOW).select("page_id", "domain").join(pins, "page_id", "left_semi")


_REFS = """refs AS (SELECT 'document' AS kind, user_id::VARCHAR AS id FROM events UNION SELECT 'document', doc_id::VARCHAR FROM labels UNION SELECT 'page', doc_id::VARCHAR FROM labels UNION SELECT 'message', conv_id || '/' || max(turn) FROM conversations GROUP BY conv_id
  UNION SELECT 'access', max(event_id)::VARCHAR FROM events GROUP BY user_id UNION SELECT 'mark', doc_id::VARCHAR FROM labels UNION SELECT 'item', user_id::VARCHAR FROM events),
known AS (SELECT 'document' AS kind, doc_id::VARCHAR AS id, source AS origin FROM documents UNION ALL SELECT 'page', page_id::VARCHAR, url FROM pages UNION ALL SELECT 'message', conv_id || '/' || turn, role FROM conversations
  UNION ALL SELECT 'access', event_id::VARCHAR, event_type FROM events UNION ALL SELECT 'mark', doc_id::VARCHAR, CASE WHEN toxic = 1 THEN 'suppress' WHEN quality = 1 THEN 'promote' ELSE 'cold' END FROM labels UNION ALL SELECT 'item', item_id::VARCHAR, 'benchmark' FROM benchmark)"""


@query("j18_provenance", f"WITH {_REFS} SELECT kind, id, origin FROM known SEMI JOIN refs USING (kind, id)")
def j18(spark, d):
    """All entities of six kinds that a table of references names: targets of accesses and marks, last messages and accesses."""
    e = lambda t: E.read(spark, d, t)
    text = lambda c: F.col(c).cast("string")
    ref = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("id"))
    row = lambda df, kind, key, origin: df.select(F.lit(kind).alias("kind"), key.alias("id"), origin.alias("origin"))
    events, labels = e("events"), e("labels")
    refs = ref(events, "document", text("user_id")).union(ref(labels, "document", text("doc_id"))).union(ref(labels, "page", text("doc_id"))).union(ref(labels, "mark", text("doc_id"))).union(ref(events, "item", text("user_id")))
    refs = refs.union(ref(e("conversations").groupBy("conv_id").agg(F.max("turn").alias("turn")), "message", F.concat_ws("/", "conv_id", "turn"))).union(ref(events.groupBy("user_id").agg(F.max("event_id").alias("event_id")), "access", text("event_id")))
    known = row(e("documents"), "document", text("doc_id"), F.col("source")).union(row(e("pages"), "page", text("page_id"), F.col("url"))).union(row(e("conversations"), "message", F.concat_ws("/", "conv_id", "turn"), F.col("role")))
    known = known.union(row(events, "access", text("event_id"), F.col("event_type"))).union(row(E.marks(spark, d), "mark", text("target_id"), F.col("action"))).union(row(e("benchmark"), "item", text("item_id"), F.lit("benchmark")))
    return known.join(refs.distinct(), ["kind", "id"], "left_semi")


@query("a5_document_centroids", f"""WITH {O.WHOLE_CHUNKS}, {O.embeddings('chunks', 'document_id, ordinal')}, x AS (SELECT document_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb)
SELECT document_id, round(sum(c) , 4) AS total, round(max(c), 6) AS largest FROM (SELECT document_id, i, avg(x) AS c FROM x GROUP BY ALL) GROUP BY document_id""")
def a5(spark, d):
    # Chunks without words are null and count in no mean; a filter on a vector would have every chunk embedded twice.
    held = F.when(F.exists("embedding", lambda x: x > 0), F.col("embedding")).alias("embedding")
    e = E.embedded_chunks(spark, d, T.WHOLE, T.WHOLE).select("document_id", held).groupBy("document_id").agg(V.mean_vector(F.col("embedding")).alias("c")).filter(F.get("c", F.lit(0)).isNotNull())
    return e.select("document_id", F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("c"), 6).alias("largest"))


@query("a6_first_region", f"WITH {O.CHUNKS} SELECT document_id, arg_min('region-' || family || '-' || (ordinal % 4), ordinal) AS region FROM chunks GROUP BY document_id")
def a6(spark, d):
    r = F.concat(F.lit("region-"), "family", F.lit("-"), F.col("ordinal") % 4)
    return E.chunk_spans(spark, d).groupBy("document_id").agg(F.min_by(r, "ordinal").alias("region"))


@query("a15_baselines", f"""WITH {_RECORDS} SELECT 'train_share' AS name, round(avg(CASE WHEN split = 'train' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS score FROM records UNION ALL SELECT 'eval_share', round(avg(CASE WHEN split = 'eval' THEN 1.0 ELSE 0 END), 6) FROM records
UNION ALL SELECT 'route_majority', (SELECT round(max(n) / sum(n), 6) FROM (SELECT count(*)::DOUBLE AS n FROM records WHERE task = 'query_to_region' GROUP BY target)) UNION ALL SELECT 'anchored', round(avg(CASE WHEN contains(target, 'anchor') THEN 1.0 ELSE 0 END), 6) FROM records""")
def a15(spark, d):
    """Shares of all records from one pass: they are counted by route target, other tasks as one."""
    route = F.col("task") == "query_to_region"
    n = lambda ok, name: F.count_if(ok).cast("double").alias(name)
    counts = records(spark, d).groupBy(route.alias("route"), F.when(route, F.col("target")).alias("target")).agg(F.count("*").cast("double").alias("n"), n(F.col("split") == "train", "train"), n(F.col("split") == "eval", "eval"), n(F.contains("target", F.lit("anchor")), "anchored"))
    of_route = F.when(F.col("route"), F.col("n"))
    share = lambda part, whole: F.round(F.try_divide(part, whole), 6)
    scores = {"train_share": share(F.sum("train"), F.sum("n")), "eval_share": share(F.sum("eval"), F.sum("n")), "route_majority": share(F.max(of_route), F.sum(of_route)), "anchored": share(F.sum("anchored"), F.sum("n"))}
    return counts.agg(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("score")) for k, v in scores.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


_LINES = "SELECT source AS family, doc_id || ':' || sha256(text) AS line FROM documents WHERE length(text) > 0"


def _lines(spark, d):
    """A line a document with the hash of its whole text, so a change anywhere is seen."""
    return docs(spark, d).filter("length(text) > 0").select(F.col("source").alias("family"), "doc_id", F.concat_ws(":", "doc_id", F.sha2("text", 256)).alias("line"))


@query("a19_corpus_hash", group_digest_sql(_LINES, "family"))
def a19(spark, d):
    """Signature of each family's documents; a rebuild is due where it differs."""
    return group_digest(_lines(spark, d), ["family"])


@query("c7_stable_region_ids", f"SELECT family, 'region-' || family || '-' || left(digest, 8) AS region_id FROM ({group_digest_sql(_LINES, 'family')})")
def c7(spark, d):
    return a19(spark, d).select("family", F.concat_ws("-", F.lit("region"), "family", F.substring("digest", 1, 8)).alias("region_id"))


@query("i2_changed_signatures", f"WITH a AS ({group_digest_sql(_LINES, 'family')}), b AS ({group_digest_sql(_LINES + ' AND doc_id % 50 <> 3', 'family')}) SELECT family, coalesce(a.digest = b.digest, false) AS reusable FROM a LEFT JOIN b USING (family)")
def i2(spark, d):
    """Regions of an earlier state (some documents missing) whose index can be kept."""
    c = _lines(spark, d)
    before = group_digest(c.filter("doc_id % 50 <> 3"), ["family"]).withColumnRenamed("digest", "old")
    return group_digest(c, ["family"]).join(before, "family", "left").select("family", F.coalesce(F.col("digest") == F.col("old"), F.lit(False)).alias("reusable"))


@query("i4_index_health", "SELECT count(*) AS vectors, count(DISTINCT label) AS regions, CASE count(DISTINCT len(embedding)) WHEN 1 THEN min(len(embedding))::INT END AS dimension FROM embeddings")
def i4(spark, d):
    n = F.countDistinct(F.size("embedding"))
    return E.read(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("regions"), F.when(n == 1, F.min(F.size("embedding"))).alias("dimension"))


_WALKS = f"""{_PAIRS}, near AS (SELECT a AS id, b AS neighbour FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 4),
u AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
sim AS (SELECT q.id AS query_id, r.id, round(list_inner_product(q.v, r.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(r.v, r.v))), 6) AS s FROM u q, u r WHERE q.id % 20 = 0),
walks AS (SELECT query_id, region, sim.id, s AS score, 0 AS hop FROM sim JOIN (SELECT label AS region, min(id) AS id FROM u GROUP BY label) USING (id)
UNION ALL SELECT query_id, region, -best.m AS id, best.s AS score, hop FROM (SELECT w.query_id, w.region, w.hop + 1 AS hop, w.score AS was, max({{'s': sim.s, 'm': -near.neighbour}}) AS best FROM walks w JOIN near ON near.id = w.id JOIN sim ON sim.query_id = w.query_id AND sim.id = near.neighbour GROUP BY ALL) WHERE best.s > was),
ends AS (SELECT query_id, region, id, score FROM walks QUALIFY row_number() OVER (PARTITION BY query_id, region ORDER BY hop DESC) = 1),
around AS (SELECT * FROM ends UNION SELECT e.query_id, region, neighbour, s FROM ends e JOIN near USING (id) JOIN sim ON sim.query_id = e.query_id AND sim.id = neighbour)"""


@query("i3_graph_search", f"WITH RECURSIVE {_WALKS} SELECT query_id, region, id, score, (row_number() OVER (PARTITION BY query_id, region ORDER BY score DESC, id))::INT AS rank FROM around QUALIFY rank <= 5")
def i3(spark, d):
    """Greedy walks of the queries (ids divisible by 20) in every region's four-neighbour graph."""
    from memspark.operators.similarity import semantic_links
    from memspark.operators.search import greedy_search

    e = E.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.unit(F.col("embedding")).alias("v"), "label")
    edges = semantic_links(e, -1.0, 4, "label").select(F.col("a").alias("id"), F.col("b").alias("neighbour"))
    rows = e.select(F.col("label").alias("region"), "id", F.col("id").alias("ordinal"), "v")
    asked = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return greedy_search(asked, rows, edges, 5).select("query_id", "region", "id", "score", "rank")


@query("a21_single_folder", "SELECT host, CASE WHEN count(DISTINCT folder) = 1 THEN min(folder) END AS folder FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS folder FROM pages) GROUP BY host")
def a21(spark, d):
    p = E.read(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2)).alias("folder"))
    return p.groupBy("host").agg(F.when(F.countDistinct("folder") == 1, F.min("folder")).alias("folder"))


@query("a24_training_provenance", "SELECT source, count(*) FILTER (coalesce(toxic, 0) = 0) AS included, count(*) FILTER (toxic = 1) AS excluded, bool_and(lang = 'en') AS english_only FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source")
def a24(spark, d):
    toxic = E.read(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs(spark, d).select("doc_id", "source", "lang").join(toxic, "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.coalesce("toxic", F.lit(0)) == 0).alias("included"), F.count_if(F.col("toxic") == 1).alias("excluded"), F.bool_and(F.col("lang") == "en").alias("english_only"))


@query("a25_trace_evaluation", f"SELECT conv_id, count(*) FILTER (role <> 'user') AS calls, sum(ceil(len({O.words('text')}) * 1.35::DOUBLE))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def a25(spark, d):
    m = E.messages(spark, d)
    return m.groupBy(F.col("session_id").alias("conv_id")).agg(F.count_if(F.col("role") != "user").alias("calls"), F.sum(T.token_estimate(F.col("content")).cast("long")).alias("tokens"))


_BASIS = K.projection_basis(64)
_AXES = ", ".join(f"list_inner_product(embedding::DOUBLE[], {list(map(float, b))!r}::DOUBLE[]) AS {n}" for n, b in zip("xyz", _BASIS, strict=True))


@query("v3_positions", f"""WITH r AS (SELECT vec_id, {_AXES} FROM embeddings), c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM r), s AS (SELECT vec_id, x - cx AS x, y - cy AS y, z - cz AS z FROM r, c), m AS (SELECT greatest(0.001, max(sqrt(x * x + y * y + z * z))) AS radius FROM s)
SELECT vec_id, round(x * 18 / radius, 3) AS x, round(y * 18 / radius, 3) AS y, round(z * 18 / radius, 3) AS z FROM s, m""")
def v3(spark, d):
    return K.positions(E.read(spark, d, "embeddings"))


@query("a27_position_centroid", f"""WITH r AS (SELECT vec_id, label, {_AXES} FROM embeddings), c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM r), s AS (SELECT label, x - cx AS x, y - cy AS y, z - cz AS z FROM r, c), m AS (SELECT greatest(0.001, max(sqrt(x * x + y * y + z * z))) AS radius FROM s)
SELECT label, round(avg(round(x * 18 / radius, 3)) + 1e-7, 4) AS x, round(avg(round(y * 18 / radius, 3)) + 1e-7, 4) AS y, round(avg(round(z * 18 / radius, 3)) + 1e-7, 4) AS z FROM s, m GROUP BY label""")
def a27(spark, d):
    """Where each region lies: the mean of its vectors' projected positions."""
    e = E.read(spark, d, "embeddings")
    at = K.positions(e).join(e.select("vec_id", "label"), "vec_id")
    return at.groupBy("label").agg(*[F.round(F.avg(n) + 1e-7, 4).alias(n) for n in "xyz"])


@query("r8_context_boost", f"""WITH {O.ACCESSES}, w AS (SELECT target_id % 20 AS k, round(least(0.6, sum({O.ACCESS_WEIGHT})), 6)::DOUBLE AS s FROM accesses GROUP BY 1)
SELECT doc_id, round(greatest(least(coalesce(sum(s), 0), 0.34), -0.28), 6)::DOUBLE AS boost FROM (SELECT DISTINCT doc_id, unnest([doc_id % 20, (doc_id // 20) % 20]) AS k FROM documents) LEFT JOIN w USING (k) GROUP BY doc_id""")
def r8(spark, d):
    """A document's context values (a comma-separated list) look up the scores of those contexts; the sum is clamped."""
    scores = E.accesses(spark, d).groupBy((F.col("target_id") % 20).cast("string").alias("value")).agg(F.round(F.least(F.lit(0.6), F.sum(E.lookup(F.col("kind"), E.ACCESS_WEIGHTS))), 6).alias("s"))
    rows = docs(spark, d).select("doc_id", F.concat_ws(" , ", F.col("doc_id") % 20, F.floor(F.col("doc_id") / 20) % 20).alias("context"))
    return K.context_boost(rows, "doc_id", "context", scores)


@query("r12_score_keys", f"WITH {O.MARKS} SELECT 'document:' || target_id AS key, count(*) AS marks FROM marks GROUP BY 1")
def r12(spark, d):
    return E.marks(spark, d).groupBy(F.concat(F.lit("document:"), "target_id").alias("key")).agg(F.count("*").alias("marks"))


@query("g1_link_counts", f"WITH {O.CHUNKS} SELECT 'same_document' AS kind, count(*) AS links FROM (SELECT 1 FROM chunks QUALIFY lead(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) IS NOT NULL) UNION ALL SELECT 'region_membership', count(*) FROM embeddings")
def g1(spark, d):
    from memspark.operators.graph import sequence_links

    same = sequence_links(E.chunk_spans(spark, d)).select(F.lit("same_document").alias("kind"))
    return same.union(E.read(spark, d, "embeddings").select(F.lit("region_membership"))).groupBy("kind").agg(F.count("*").alias("links"))


@query("n8_open_targets", """SELECT 'page:' || page_id AS node, 'url' AS kind FROM pages UNION ALL SELECT 'document:' || doc_id, CASE WHEN lang = 'fr' THEN 'pdf_page' ELSE 'text_offset' END FROM documents
UNION ALL SELECT 'outline:' || conv_id || ':' || turn, 'markdown_heading' FROM conversations UNION ALL SELECT 'memory:' || conv_id || ':' || turn, 'generated' FROM conversations WHERE role = 'assistant'""")
def n8(spark, d):
    """Captured pages open as urls, documents at their offset (French ones as if they were paged PDFs), turns of Markdown outlines at their heading, memories as generated."""
    fields = ("email_thread_id", "url", "page", "section", "source_type", "path")
    given = lambda **known: F.struct(*[known.get(f, F.lit(None)).cast("string").alias(f) for f in fields]).alias("m")
    node = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts).alias("node")
    turns = E.messages(spark, d)
    paged = F.col("lang") == "fr"
    path = F.concat(F.lit("/lib/"), "doc_id", F.when(paged, ".pdf").otherwise(".txt"))
    rows = E.read(spark, d, "pages").select(node("page", "page_id"), given(url=F.col("url"), source_type=F.lit("web_finding")))
    rows = rows.union(docs(spark, d).select(node("document", "doc_id"), given(path=path, page=F.when(paged, 1), source_type=F.lit("local_file"))))
    rows = rows.union(turns.select(node("outline", "session_id", "turn"), given(path=F.lit("/chats/outline.md"), section=F.concat(F.lit("turn "), "turn"))))
    rows = rows.union(turns.filter("role = 'assistant'").select(node("memory", "session_id", "turn"), given(source_type=F.lit("derived_memory"))))
    return rows.select("node", K.open_target(F.col("m")).alias("kind"))


@query("n4_neighbours", f"""WITH {O.CHUNKS}, l AS (SELECT document_id, ordinal, unnest([ordinal - 1, ordinal + 1]) AS other FROM chunks) SELECT l.document_id, l.ordinal, l.other, 0.9::DOUBLE AS score, (row_number() OVER (PARTITION BY l.document_id, l.ordinal ORDER BY l.other))::INT AS rank FROM l JOIN chunks c ON c.document_id = l.document_id AND c.ordinal = l.other""")
def n4(spark, d):
    """Linked nodes of each chunk, best first; here the links of its document's sequence."""
    from memspark.operators.graph import sequence_links

    links = sequence_links(E.chunk_spans(spark, d))
    ends = links.select("document_id", F.explode(F.array(F.struct(F.col("source").alias("ordinal"), F.col("target").alias("other")), F.struct(F.col("target").alias("ordinal"), F.col("source").alias("other")))).alias("e"), "score").select("document_id", "e.ordinal", "e.other", "score")
    w = Window.partitionBy("document_id", "ordinal").orderBy(F.desc("score"), "other")
    return ends.withColumn("rank", F.row_number().over(w)).filter("rank <= 8")


@query("n11_grep_hits", """WITH p AS (SELECT doc_id, text, string_split(lower(text), 'tion') AS parts FROM documents), h AS (SELECT doc_id, text, unnest(range(1, len(parts))) AS k, parts FROM p), s AS (SELECT doc_id, text, k, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + 4 * (k - 1))::INT AS start FROM h)
SELECT doc_id, start, md5(substring(text, greatest(start - 90, 0) + 1, least(start + 94, length(text)) - greatest(start - 90, 0))) AS excerpt_digest FROM s""")
def n11(spark, d):
    """Case-insensitive matches with 90 characters on either side."""
    g = docs(spark, d).select("doc_id", "text", F.explode(T.grep_starts(F.col("text"), F.lit("tion"))).alias("start"))
    return g.select("doc_id", "start", F.md5(T.excerpt(F.col("text"), F.col("start"), F.col("start") + 4, 90)).alias("excerpt_digest"))


@query("m3_route_sketches", "SELECT source AS region_id, array_to_string(list_sort(list(doc_id))[1:12], ',') AS refs FROM documents GROUP BY source")
def m3(spark, d):
    """The first twelve sources of each region, ranked with a limit that Spark applies before the shuffle."""
    w = Window.partitionBy("source").orderBy("doc_id")
    top = docs(spark, d).select("source", "doc_id").withColumn("k", F.row_number().over(w)).filter("k <= 12")
    return top.groupBy(F.col("source").alias("region_id")).agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("refs"))


@query("l1_ingest_report", "SELECT count(*) AS incoming, count(*) FILTER (old.doc_id IS NOT NULL) AS replaced, count(*) FILTER (old.doc_id IS NULL) AS imported, count(*) FILTER (trim(text) = '') AS skipped FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) old USING (doc_id)")
def l1(spark, d):
    old = E.read(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = docs(spark, d).select("doc_id", (F.trim("text") == "").alias("empty")).join(old, "doc_id", "left")
    return rows.agg(F.count("*").alias("incoming"), F.count("known").alias("replaced"), F.count_if(F.col("known").isNull()).alias("imported"), F.count_if("empty").alias("skipped"))


@query("l9_source_artifacts", "SELECT 'source-artifact:' || sha256(text) AS id, min(doc_id) AS first_document, count(*) AS documents FROM documents GROUP BY 1")
def l9(spark, d):
    return docs(spark, d).groupBy(F.concat(F.lit("source-artifact:"), F.sha2("text", 256)).alias("id")).agg(F.min("doc_id").alias("first_document"), F.count("*").alias("documents"))


@query("b2_web_documents", f"WITH {O.FINDINGS} SELECT 'web:' || left(md5(domain), 16) AS document_id, arg_max(content_hash, (retrieved_at, page_id)) AS newest, count(*) AS captures FROM findings GROUP BY domain")
def b2(spark, d):
    """One document a domain: the newest capture wins."""
    f = E.findings(spark, d)
    return f.groupBy("domain").agg(F.max_by("content_hash", F.struct("retrieved_at", "page_id")).alias("newest"), F.count("*").alias("captures")).select(F.concat(F.lit("web:"), F.substring(F.md5("domain"), 1, 16)).alias("document_id"), "newest", "captures")


@query("b9_table_rows", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, 3::BIGINT AS fields FROM customer")
def b9(spark, d):
    """CSV lines made of customers (quotes, commas inside) and read back by the record parser."""
    q = F.concat(F.lit('"'), F.replace("c_name", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(q, F.lit(" , "), F.col("c_mktsegment"), F.lit(',"a, ""b"""'))
    rows = E.read(spark, d, "customer").select("c_custkey", T.csv_fields(line).alias("f"))
    return rows.select("c_custkey", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("segment"), F.size("f").cast("long").alias("fields"))


@query("t8_role_events", "SELECT conv_id, role_name, count(*) AS events FROM (SELECT conv_id, CASE WHEN text LIKE '%mark_attention%' THEN 'memory_steward' WHEN text LIKE '%response_context%' THEN 'solver' WHEN text LIKE '%critique%' THEN 'critic' WHEN role <> 'user' THEN 'retriever' ELSE 'planner' END AS role_name FROM conversations) GROUP BY ALL")
def t8(spark, d):
    line = F.concat(F.when(F.col("role") != "user", "memory_search ").otherwise(""), "content")
    return E.messages(spark, d).groupBy(F.col("session_id").alias("conv_id"), T.trace_role(line).alias("role_name")).agg(F.count("*").alias("events"))


@query("u6_missing_tasks", f"WITH {_RECORDS}, have AS (SELECT DISTINCT task FROM records WHERE split = 'eval' AND family = 'src1' AND chunk_id LIKE '1:%'), firsts AS (SELECT task, min(chunk_id) AS chunk_id FROM records WHERE split = 'test' GROUP BY task) SELECT task, chunk_id AS source_id FROM firsts WHERE task NOT IN (SELECT task FROM have)")
def u6(spark, d):
    """Tasks without a record in a subset are filled with the first test record of the task."""
    r = records(spark, d)
    have = r.filter("split = 'eval' and family = 'src1' and source_id like '1:%'").select("task").distinct()
    fill = r.filter("split = 'test'").groupBy("task").agg(F.min("source_id").alias("source_id"))
    return fill.join(have, "task", "left_anti")


@query("x1_source_anchors", f'WITH {O.CHUNKS} SELECT c.document_id, c.ordinal, strlen(left(d.text, c.start))::INT AS byte_start, strlen(left(d.text, c."end"))::INT AS byte_end FROM chunks c JOIN documents d ON d.doc_id = c.document_id')
def x1(spark, d):
    """Byte and character offsets of each chunk, cut while the document is at hand."""
    whole = docs(spark, d).select(F.col("doc_id").alias("document_id"), F.substring("text", 1, T.MAX_DOCUMENT_CHARS).alias("text"))
    c = whole.select("document_id", "text", F.explode(T.chunk_structs(F.col("text"))).alias("c"))
    return c.select("document_id", "c.ordinal", T.byte_offset(F.col("text"), F.col("c.start")).alias("byte_start"), T.byte_offset(F.col("text"), F.col("c.end")).alias("byte_end"))


@query("x13_revision_diff", f"""WITH {O.FINDINGS}, w AS (SELECT page_id, domain, content_hash, len({O.words('body')}) AS words, lag(content_hash) OVER x AS prev, lag(len({O.words('body')})) OVER x AS prev_words FROM findings WINDOW x AS (PARTITION BY domain ORDER BY retrieved_at))
SELECT page_id, 'content_hash changed ' || prev || ' -> ' || content_hash || '; words_delta=' || (words - prev_words) AS diff FROM w WHERE prev <> content_hash""")
def x13(spark, d):
    w = Window.partitionBy("domain").orderBy("retrieved_at")
    f = E.findings(spark, d).select("page_id", "domain", "retrieved_at", "content_hash", F.size(T.words(F.col("body"))).alias("words"))
    f = f.withColumn("prev", F.lag("content_hash").over(w)).withColumn("prev_words", F.lag("words").over(w)).filter("prev <> content_hash")
    return f.select("page_id", F.concat(F.lit("content_hash changed "), "prev", F.lit(" -> "), "content_hash", F.lit("; words_delta="), F.col("words") - F.col("prev_words")).alias("diff"))


@query("x11_route_probe", "SELECT arg_max(source, (n, source)) AS expected, max(n) AS chunks FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def x11(spark, d):
    n = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("source", F.struct("n", "source")).alias("expected"), F.max("n").alias("chunks"))


@query("aj4_split_values", "SELECT event_id, k::INT AS k, trim(v) AS v FROM (SELECT event_id, unnest(string_split(event_type || ' , ' || user_id || ',,', ',')) AS v, generate_subscripts(string_split(event_type || ' , ' || user_id || ',,', ','), 1) AS k FROM events) WHERE trim(v) <> ''")
def aj4(spark, d):
    v = E.read(spark, d, "events").select("event_id", F.explode(K.split_values(F.concat("event_type", F.lit(" , "), "user_id", F.lit(",,")))).alias("v"))
    return v.withColumn("k", F.when(F.col("v").rlike("^[0-9]+$"), 2).otherwise(1))


@query("aj8_json_slice", "SELECT event_id, regexp_extract('plan: ' || props || ' done', '(?s)\\{.*\\}') AS body FROM events")
def aj8(spark, d):
    return E.read(spark, d, "events").select("event_id", F.regexp_extract(F.concat(F.lit("plan: "), "props", F.lit(" done")), "(?s)\\{.*\\}", 0).alias("body"))


@query("x16_prompt_records", f"WITH {_RECORDS} SELECT split, count(*) AS rows, count(DISTINCT target) AS completions FROM records GROUP BY split")
def x16(spark, d):
    return records(spark, d).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("target").alias("completions"))
