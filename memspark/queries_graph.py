"""Queries on the link graph, joins and windows (G, J, W, U, N rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import text as T
from memspark.operators import graph as L
from memspark.operators import navigation as N
from memspark.operators import sessions as SE
from memspark.operators import references as RF
from memspark.operators import similarity as Y
from memspark.operators.sinks import latest, upsert
from memspark.plans import entities as E
from memspark.registry import query


@query("g3_sequence_links", f"WITH {O.CHUNKS} SELECT document_id, ordinal AS source, (ordinal + 1)::INT AS target, 0.9::DOUBLE AS score FROM chunks QUALIFY lead(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) IS NOT NULL")
def g3(spark, d):
    return L.sequence_links(E.chunk_spans(spark, d))


@query("g2_region_membership", "SELECT 'l' || label AS region_id, vec_id, 1.0::DOUBLE AS score FROM embeddings")
def g2(spark, d):
    return E.read(spark, d, "embeddings").select(F.concat(F.lit("l"), "label").alias("region_id"), "vec_id", F.lit(1.0).alias("score"))


def _cited(spark, d):
    """Documents that cite the document of the next id and its neighbour by two forms (the tables hold no citations)."""
    doc = E.read(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")
    more = F.concat(F.lit(" cite:doc-"), F.col("doc_id") + 1, F.lit(". [@doc-"), F.col("doc_id") + 2, F.lit("; @missing] [["), F.lit("doc-"), F.col("doc_id") + 3, F.lit(".md]]"))
    return doc.select("id", F.lit("").alias("title"), F.concat("text", more).alias("text"))


@query("g4_citation_links", "SELECT 'doc-' || a.doc_id AS source, 'doc-' || b.doc_id AS target, 0.8::DOUBLE AS score FROM documents a JOIN documents b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2)")
def g4(spark, d):
    return L.citation_links(_cited(spark, d))


@query("g5_explicit_links", "SELECT 'doc-' || a.doc_id AS source, 'doc-' || b.doc_id AS target, 0.82::DOUBLE AS score FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 3")
def g5(spark, d):
    return L.explicit_links(_cited(spark, d))


_REF = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^[/\"'']+|[/\"'']+$', '', 'g'), '(\\.md)+$', ''), '(\\.markdown)+$', '')), '[^a-z0-9-]', '', 'g')"
_TITLE = r"regexp_extract(html, '<title>(.*?)</title>', 1, 's')"


@query("j9_path_references", rf"""WITH p AS (SELECT page_id, {_REF.format("page_id::VARCHAR")} AS id, {_REF.format(_TITLE)} AS title, {_REF.format("url")} AS path FROM pages),
r AS (SELECT DISTINCT source, {_REF.format("raw")} AS ref FROM (SELECT page_id AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM pages)),
t AS (SELECT ref, min(page_id) AS target FROM (SELECT DISTINCT ref FROM r WHERE ref <> '') JOIN p ON id = ref OR title = ref OR contains(path, ref) GROUP BY ref)
SELECT DISTINCT source, target, 0.82::DOUBLE AS score FROM r JOIN t USING (ref) WHERE source <> target""")
def j9(spark, d):
    """Links of captured pages resolved against pages by id, title or part of the url; the smallest id wins."""
    p = E.read(spark, d, "pages")
    docs = p.select(F.col("page_id").alias("id"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.col("url").alias("path"))
    return RF.reference_links(p.select(F.col("page_id").alias("source"), "html"), docs, F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))


_PAIRS = f"""pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) + {Y.NUDGE}, 6) AS score
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


def _unit(spark, d):
    from memspark.functions import vector as V

    return E.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.unit(F.col("embedding")).alias("v"), "label")


@query("i1_region_neighbours", f"WITH {_PAIRS} SELECT a AS vec_id, b AS neighbour, score, (row_number() OVER (PARTITION BY a ORDER BY score DESC, b))::INT AS rank FROM pairs QUALIFY rank <= 4")
def i1(spark, d):
    """Exact graph of the four nearest rows within a region (label)."""
    return Y.semantic_links(_unit(spark, d), -1.0, 4, "label").select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), "score", "rank")


@query("j7_visual_edges", f"WITH {_PAIRS}, t AS (SELECT a, b, score FROM pairs WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 2) SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM t GROUP BY 1, 2")
def j7(spark, d):
    return L.canonical_pairs(Y.semantic_links(_unit(spark, d), 0.25, 2, "label"))


_CHUNK_LINKS = f"""{O.embeddings('chunks', 'document_id, ordinal')}, ev AS (SELECT document_id * {T.MAX_CHUNKS} + ordinal AS id, family, v FROM emb JOIN chunks USING (document_id, ordinal)),
cl AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM (SELECT x.id AS a, y.id AS b, round({O.dot('x.v', 'y.v')} + {Y.NUDGE}, 6) AS score FROM ev x JOIN ev y ON x.id <> y.id WHERE round({O.dot('x.v', 'y.v')} + {Y.NUDGE}, 6) >= 0.72 QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY score DESC, y.id) <= 3) GROUP BY 1, 2)"""


@query("g6_chunk_links", f"WITH {O.CHUNKS}, {_CHUNK_LINKS} SELECT a, b, score FROM cl")
def g6(spark, d):
    """Chunks of any sources with similarity of 0.72 or more: three best, each pair once."""
    c = E.embedded_chunks(spark, d).select((F.col("document_id") * T.MAX_CHUNKS + F.col("ordinal")).alias("id"), F.col("embedding").alias("v"))
    return L.canonical_pairs(Y.semantic_links(c, 0.72, 3))


_ENT = rf"""t AS (SELECT DISTINCT item_id, lower(w) AS e FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{M}}\p{{N}}_-]+')) AS w FROM benchmark) WHERE (regexp_matches(w, '^[A-Z]+$') OR (regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '^.+[a-z]'))) AND strlen(w) >= 4 AND lower(w) NOT IN {O.in_list(T.ENTITY_STOP_WORDS)})"""


@query("g7_entity_links", f"WITH {_ENT} SELECT a.item_id AS source, b.item_id AS target, count(*) AS shared, round(least(0.48 + least(count(*), 5) * 0.04, 0.68)::DOUBLE, 6) AS score FROM t a JOIN t b USING (e) WHERE a.item_id < b.item_id GROUP BY ALL")
def g7(spark, d):
    """Items that share entities: an equi-join on the entity, counted per pair."""
    e = E.read(spark, d, "benchmark").select("item_id", F.explode(T.entities(F.lit(""), F.col("text"))).alias("e"))
    other = e.select(F.col("item_id").alias("target"), "e")
    pairs = e.select(F.col("item_id").alias("source"), "e").join(other, "e").filter("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("shared")).withColumn("score", F.round(T.overlap_score(F.col("shared")), 6))


@query("g11_suppressed", f"WITH {O.MARKS} SELECT target_id FROM marks GROUP BY target_id HAVING bool_or(action = 'suppress') AND NOT bool_or(action IN ('pin', 'promote', 'hot'))")
def g11(spark, d):
    return L.suppressed(E.marks(spark, d))


@query("j17_unsuppressed_documents", f"WITH {O.MARKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT target_id FROM marks GROUP BY target_id HAVING bool_or(action = 'suppress') AND NOT bool_or(action IN ('pin', 'promote', 'hot')))")
def j17(spark, d):
    down = L.suppressed(E.marks(spark, d)).withColumnRenamed("target_id", "doc_id")
    return E.read(spark, d, "documents").select("doc_id").join(down, "doc_id", "left_anti")


@query("n1_links_of_nodes", f"WITH {O.CHUNKS}, l AS (SELECT document_id, ordinal AS s, ordinal + 1 AS t FROM chunks QUALIFY lead(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) IS NOT NULL) SELECT document_id, node, count(*) AS links FROM (SELECT document_id, s AS node FROM l UNION ALL SELECT document_id, t FROM l) GROUP BY ALL")
def n1(spark, d):
    links = L.sequence_links(E.chunk_spans(spark, d))
    link = links.select(F.concat_ws(":", "document_id", "source").alias("source"), F.concat_ws(":", "document_id", "target").alias("target"))
    ends = N.both_ways(link)
    return ends.groupBy("node").agg(F.count("*").alias("links")).select(F.split_part("node", F.lit(":"), F.lit(1)).cast("long").alias("document_id"), F.split_part("node", F.lit(":"), F.lit(2)).cast("int").alias("node"), "links")


@query("n2_session_replay", """WITH RECURSIVE e AS (SELECT user_id AS session_id, CASE WHEN event_type = 'error' THEN 'back' ELSE 'open' END AS action, 'n' || (event_id % 7) AS node, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT session_id, 0::BIGINT AS k, NULL::VARCHAR AS current, []::VARCHAR[] AS history FROM (SELECT DISTINCT session_id FROM e)
UNION ALL SELECT s.session_id, e.k, CASE WHEN e.action = 'back' THEN coalesce(s.history[-1], s.current) ELSE e.node END,
CASE WHEN e.action = 'back' THEN CASE WHEN len(s.history) > 0 THEN s.history[:-2] ELSE s.history END WHEN s.current IS NULL THEN s.history ELSE list_append(s.history, s.current) END FROM s JOIN e ON e.session_id = s.session_id AND e.k = s.k + 1)
SELECT session_id, current, len(history)::BIGINT AS depth FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1""")
def n2(spark, d):
    """Events as a navigation log: an error goes back, all else opens a node."""
    e = E.read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "back").otherwise("open").alias("action"), F.concat(F.lit("n"), F.col("event_id") % 7).alias("node"))
    return SE.states(e, SE.stacks(e)).select("session_id", "current", F.col("before").alias("depth"))


@query("j22_section_boxes", f'WITH {O.CHUNKS} SELECT document_id, (start // 2000)::BIGINT AS page, min(start) AS start, max("end") AS "end" FROM chunks GROUP BY ALL')
def j22(spark, d):
    """Bounding box of a page's chunks; a chunk's page is that of its start."""
    c = E.chunk_spans(spark, d).withColumn("page", F.floor(F.col("start") / 2000))
    return N.bounding_boxes(c, ["document_id", "page"])


@query("w3_first_occurrence", "SELECT text AS content, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def w3(spark, d):
    """Grouped by digest first, so texts don't pass the counting shuffle."""
    docs = E.read(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")
    return docs.join(firsts.select("doc_id", "copies"), "doc_id").select(F.col("text").alias("content"), "doc_id", "copies")


@query("w4_revisions", f"WITH {O.FINDINGS} SELECT page_id, domain, prev AS previous_hash, content_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY domain ORDER BY retrieved_at) AS prev FROM findings) WHERE prev IS NOT NULL AND prev <> content_hash")
def w4(spark, d):
    w = Window.partitionBy("domain").orderBy("retrieved_at")
    f = E.findings(spark, d).select("page_id", "domain", "content_hash", "retrieved_at").withColumn("previous_hash", F.lag("content_hash").over(w))
    return f.filter("previous_hash is not null and previous_hash <> content_hash").select("page_id", "domain", "previous_hash", "content_hash")


@query("w9_latest_row", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w9(spark, d):
    e = E.read(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("w10_hot_context_ranking", "SELECT conv_id, turn, rank::INT AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round(length(text) / 1000.0 + 0.4 * (CASE WHEN role = 'user' THEN 1.0 ELSE 0.25 END) + CASE WHEN role = 'user' THEN 1.5 ELSE 0.4 END, 6) DESC, turn) AS rank FROM conversations) WHERE rank <= 8")
def w10(spark, d):
    user = F.col("role") == "user"
    rank = F.round(F.length("content") / 1000.0 + 0.4 * F.when(user, 1.0).otherwise(0.25) + F.when(user, 1.5).otherwise(0.4), 6)
    w = Window.partitionBy("session_id").orderBy(F.desc("score"), "turn")
    return E.messages(spark, d).withColumn("score", rank).withColumn("rank", F.row_number().over(w)).filter("rank <= 8").select(F.col("session_id").alias("conv_id"), "turn", "rank")


@query("j1_chunk_document_join", f"WITH {O.CHUNKS} SELECT c.document_id, c.ordinal, d.lang FROM chunks c JOIN documents d ON d.doc_id = c.document_id")
def j1(spark, d):
    """Only keys and ordinals are joined; the chunk text is pruned before the shuffle."""
    c = E.chunk_spans(spark, d).select("document_id", "ordinal")
    return c.join(E.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang"), "document_id")


@query("j3_routed_chunks", f"WITH {O.CHUNKS} SELECT family, count(*) AS chunks FROM chunks WHERE family IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 3) GROUP BY family")
def j3(spark, d):
    routed = E.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3).select(F.col("source").alias("family"))
    return E.chunk_spans(spark, d).join(routed, "family", "left_semi").groupBy("family").agg(F.count("*").alias("chunks"))


@query("j10_upsert", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id + 1000000000, 'added' FROM documents WHERE doc_id % 10 = 0")
def j10(spark, d):
    old = E.read(spark, d, "documents").select("doc_id", "lang")
    new = old.filter("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("lang")).union(old.filter("doc_id % 10 = 0").select(F.col("doc_id") + 1_000_000_000, F.lit("added")))
    return upsert(old, new, ["doc_id"])


@query("j11_replaced_imported", "SELECT CASE WHEN l.doc_id IS NULL THEN 'imported' ELSE 'replaced' END AS fate, count(*) AS documents FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def j11(spark, d):
    known = E.read(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    docs = E.read(spark, d, "documents").select("doc_id").join(known, "doc_id", "left")
    return docs.groupBy(F.when(F.col("known"), "replaced").otherwise("imported").alias("fate")).agg(F.count("*").alias("documents"))


@query("j13_embedding_cache", f"WITH {O.CHUNKS}, cache AS (SELECT document_id, ordinal, md5(text) AS h FROM chunks WHERE document_id % 2 = 0) SELECT c.document_id % 2 = 0 AS even, count(*) AS chunks, count(cache.h) AS reused FROM chunks c LEFT JOIN cache ON cache.document_id = c.document_id AND cache.ordinal = c.ordinal AND cache.h = md5(c.text) GROUP BY 1")
def j13(spark, d):
    c = E.chunks(spark, d).select("document_id", "ordinal", F.md5("text").alias("h"))
    cache = c.filter("document_id % 2 = 0").withColumn("hit", F.lit(1))
    return c.join(cache, ["document_id", "ordinal", "h"], "left").groupBy((F.col("document_id") % 2 == 0).alias("even")).agg(F.count("*").alias("chunks"), F.count("hit").alias("reused"))


@query("u3_shared_entities", f"WITH {_ENT}, l AS (SELECT item_id, list_sort(list(e)) AS es FROM t GROUP BY item_id) SELECT a.item_id, array_to_string(list_sort(list_intersect(a.es, b.es))[1:8], ',') AS shared FROM l a JOIN l b ON b.item_id = a.item_id + 1")
def u3(spark, d):
    e = E.read(spark, d, "benchmark").select("item_id", T.entities(F.lit(""), F.col("text")).alias("es")).filter(F.size("es") > 0)
    nxt = e.select((F.col("item_id") - 1).alias("item_id"), F.col("es").alias("other"))
    return e.join(nxt, "item_id").select("item_id", F.array_join(F.slice(F.array_sort(F.array_intersect("es", "other")), 1, 8), ",").alias("shared"))


@query("u8_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def u8(spark, d):
    return E.read(spark, d, "documents").select("doc_id").join(E.read(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("s7_filtered_scan", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type = 'click'")
def s7(spark, d):
    return E.read(spark, d, "events").filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("event_type") == "click")).select("event_id", "user_id")


@query("k2_latest_view", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def k2(spark, d):
    return latest(E.read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])
