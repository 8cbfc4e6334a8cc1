"""Queries on document links, the whole link graph, signal ranking and context snippets (J, G, U, R, X, B rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import text as T
from memspark.functions import vector as V
from memspark.operators import graph as L
from memspark.operators import knowledge as K
from memspark.operators import navigation as N
from memspark.operators import retrieval as R
from memspark.operators import signals as S
from memspark.operators import similarity as Y
from memspark.plans import entities as E
from memspark.plans.scratch import written
from memspark.queries_graph import _CHUNK_LINKS, _cited
from memspark.queries_retrieval import asked, hybrid_sql
from memspark.registry import query

NOW = E.NOW_MS
#: Similarity from which documents are neighbours, and links of a document.
DOCUMENT_SIMILARITY, DOCUMENT_LINKS = 0.58, 3

_ENTITIES = rf"""named AS (SELECT doc_id, list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{M}}\p{{N}}_-]+'), lambda w: (regexp_matches(w, '^[A-Z]+$') OR (regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '^.+[a-z]'))) AND strlen(w) >= 4), lambda w: lower(w)), lambda w: w NOT IN {O.in_list(T.ENTITY_STOP_WORDS)})) AS es FROM documents)"""
_CENTROIDS = """av AS (SELECT document_id, any_value(family) AS family, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, ordinal FROM (SELECT document_id, family, ordinal, coalesce(v, [0::DOUBLE for i in range(64)]) AS embedding FROM chunks LEFT JOIN emb USING (document_id, ordinal)) GROUP BY document_id, ordinal, embedding),
mean AS (SELECT document_id, any_value(family) AS family, i, avg(x) AS x FROM av GROUP BY document_id, i),
centre AS (SELECT document_id AS id, any_value(family) AS family, list(x / n ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY document_id)) AS n FROM mean) WHERE n > 0 GROUP BY document_id)"""
_DOCUMENT_LINKS = f"""{_ENTITIES}, {_CENTROIDS},
dp AS (SELECT x.id AS a, y.id AS b, round({O.dot('x.v', 'y.v')} + {Y.NUDGE}, 6) AS sim FROM centre x JOIN centre y ON x.id <> y.id),
en AS (SELECT doc_id AS id, unnest(es) AS e FROM named), eo AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM en x JOIN en y USING (e) WHERE x.id <> y.id GROUP BY 1, 2),
dc AS (SELECT a, b, 'semantic_neighbor' AS kind, sim AS score FROM dp WHERE sim >= {DOCUMENT_SIMILARITY} UNION ALL SELECT a, b, 'entity_overlap', round(least(0.48 + 0.04 * least(n, 5), 0.68)::DOUBLE, 6) FROM eo JOIN dp USING (a, b) WHERE sim < {DOCUMENT_SIMILARITY}),
dl AS (SELECT c.*, len(list_intersect(x.es, y.es))::BIGINT AS shared FROM (SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {DOCUMENT_LINKS}) c JOIN named x ON x.doc_id = c.a JOIN named y ON y.doc_id = c.b)"""
_EMBEDDED = f"{O.CHUNKS}, {O.embeddings('chunks', 'document_id, ordinal')}"


def document_links(spark, d, chunks=None):
    """Centroid similarity, else shared entities, among all documents; three best each."""
    chunks = E.embedded_chunks(spark, d) if chunks is None else chunks
    centre = chunks.groupBy("document_id").agg(V.mean_vector(F.col("embedding")).alias("c")).filter(F.exists("c", lambda x: x != 0))
    names = E.read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.entities(F.lit(""), F.col("text")).alias("entities"))
    rows = centre.select(F.col("document_id").alias("id"), V.unit(F.col("c")).alias("v")).join(names, "id")
    return Y.document_links(rows, DOCUMENT_SIMILARITY, DOCUMENT_LINKS)


@query("g7_document_links", f"WITH {_EMBEDDED}, {_DOCUMENT_LINKS} SELECT a, b, kind, score, shared FROM dl")
def g7(spark, d):
    return document_links(spark, d).select("a", "b", "kind", "score", "shared")


@query("g1_link_graph", f"""WITH {_EMBEDDED}, {_DOCUMENT_LINKS}, {_CHUNK_LINKS.partition(', ev AS')[2] and 'ev AS' + _CHUNK_LINKS.partition(', ev AS')[2]},
links AS (SELECT 'same_document' AS kind, 0.9::DOUBLE AS score FROM chunks QUALIFY lead(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) IS NOT NULL
UNION ALL SELECT 'region_membership', 1.0 FROM chunks UNION ALL SELECT 'citation_reference', 0.8 FROM documents a JOIN documents b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2) UNION ALL SELECT 'citation_reference', 0.82 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 3
UNION ALL SELECT 'semantic_neighbor', score FROM cl UNION ALL SELECT kind, score FROM dl)
SELECT kind, count(*) AS links, min(score) AS least, max(score) AS most FROM links GROUP BY kind""")
def g1(spark, d):
    """All kinds of links as one table (id, kind, source, target, score), one link an id; counted by kind."""
    return link_graph(spark, d).groupBy("kind").agg(F.count("*").alias("links"), F.min("score").alias("least"), F.max("score").alias("most"))


def link_graph(spark, d):
    """The union of every kind of link; of links with one id the first by kind stays."""
    chunks = written(E.embedded_chunks(spark, d).drop("text"), "graph-chunks")
    node = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts)
    link = lambda df, tag, kind, source, target: df.select(F.concat_ws(":", F.lit(tag), source, target).alias("id"), kind.alias("kind"), source.alias("source"), target.alias("target"), F.col("score"))
    sequence = L.sequence_links(chunks.select("document_id", "ordinal"))
    same = link(sequence, "sequence", F.lit("same_document"), node("chunk", "document_id", F.col("source")), node("chunk", "document_id", F.col("target")))
    member = link(chunks.select("document_id", "ordinal", "family", F.lit(1.0).alias("score")), "member", F.lit("region_membership"), node("region", "family"), node("chunk", "document_id", "ordinal"))
    cited = _cited(spark, d)
    refs = [link(f(cited), tag, F.lit("citation_reference"), F.col("source"), F.col("target")) for f, tag in ((L.citation_links, "cite"), (L.explicit_links, "explicit"))]
    near = L.canonical_pairs(Y.semantic_links(chunks.select((F.col("document_id") * T.MAX_CHUNKS + F.col("ordinal")).alias("id"), F.col("embedding").alias("v")), 0.72, 3))
    part = lambda c: node("chunk", F.floor(F.col(c) / T.MAX_CHUNKS), F.col(c) % T.MAX_CHUNKS)
    semantic = link(near, "semantic", F.lit("semantic_neighbor"), part("a"), part("b"))
    docs = document_links(spark, d, chunks)
    between = link(docs, "doc-link", F.col("kind"), node("document", "a"), node("document", "b"))
    every = same.union(member).union(refs[0]).union(refs[1]).union(semantic).union(between)
    return every.groupBy("id").agg(F.min(F.struct("kind", "source", "target", "score")).alias("l")).select("id", "l.*")


_CHUNK_PAIRS = "ev AS" + _CHUNK_LINKS.partition(", ev AS")[2]
_DOWN = f"{O.MARKS}, down AS (SELECT target_id FROM marks GROUP BY target_id HAVING bool_or(action = 'suppress') AND NOT bool_or(action IN ('pin', 'promote', 'hot')))"


@query("g8_region_enrichment", f"""WITH {_EMBEDDED}, {_DOCUMENT_LINKS}, {_CHUNK_PAIRS},
l AS (SELECT x.source AS ra, y.source AS rb FROM dl JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b UNION SELECT x.source, y.source FROM cl JOIN documents x ON x.doc_id = a // {T.MAX_CHUNKS} JOIN documents y ON y.doc_id = b // {T.MAX_CHUNKS})
SELECT region, string_agg(DISTINCT other, ',' ORDER BY other) AS neighbours FROM (SELECT ra AS region, rb AS other FROM l WHERE ra <> rb UNION ALL SELECT rb, ra FROM l WHERE ra <> rb) GROUP BY region""")
def g8(spark, d):
    """Regions become neighbours where a link of their documents or chunks crosses from one to the other."""
    chunks = written(E.embedded_chunks(spark, d).drop("text"), "graph-chunks")
    near = Y.semantic_links(chunks.select((F.col("document_id") * T.MAX_CHUNKS + F.col("ordinal")).alias("id"), F.col("embedding").alias("v")), 0.72, 3)
    of = lambda c: F.floor(F.col(c) / T.MAX_CHUNKS).alias(c)
    pairs = document_links(spark, d, chunks).select("a", "b").union(near.select(of("a"), of("b"))).distinct()
    region = E.read(spark, d, "documents").select("doc_id", "source")
    side = lambda c, name: region.select(F.col("doc_id").alias(c), F.col("source").alias(name))
    return K.region_neighbours(pairs.join(side("a", "ra"), "a").join(side("b", "rb"), "b"))


@query("g10_link_inspection", f"""WITH {_EMBEDDED}, {_DOCUMENT_LINKS}, m AS (SELECT doc_id AS a, bool_or(toxic = 1) AS suppressed, bool_or(quality = 1 AND toxic = 0) AS promoted FROM labels GROUP BY doc_id)
SELECT a AS source, b AS target, kind, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS confidence, coalesce(suppressed, false) AS suppressed, coalesce(promoted, false) AS promoted, 'graph-builder' AS actor FROM dl LEFT JOIN m USING (a)""")
def g10(spark, d):
    """Document links with their confidence, who made them and what marks say of their source."""
    links = document_links(spark, d).select(F.col("a").alias("source"), F.col("b").alias("target"), "kind", "score")
    return K.inspect_links(links, E.marks(spark, d)).drop("score", "reason", "pinned")


@query("x20_visible_links", f"WITH {_EMBEDDED}, {_DOCUMENT_LINKS}, {_DOWN} SELECT a AS source, b AS target FROM dl WHERE a NOT IN (FROM down) AND b NOT IN (FROM down)")
def x20(spark, d):
    """A traversal sees document links only where neither end is suppressed."""
    down = written(L.suppressed(E.marks(spark, d)), "suppressed")
    links = document_links(spark, d).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return links.join(down.withColumnRenamed("target_id", "source"), "source", "left_anti").join(down.withColumnRenamed("target_id", "target"), "target", "left_anti").select("source", "target")


_MARKED = f"m AS (SELECT target_id, round(sum({O.MARK_DELTA}), 6)::DOUBLE AS mark_score FROM marks GROUP BY target_id)"
_AGE = f"(greatest({NOW} - accessed_at, 0) / 604800000::DOUBLE)"
_ACCESS = f"scores AS (SELECT target_id, round(least(0.6, sum(({O.ACCESS_WEIGHT})::DOUBLE * CASE WHEN {_AGE} >= 1 THEN 0.25::DOUBLE ELSE 0.45::DOUBLE + 0.55::DOUBLE * (1 - {_AGE}) END)), 6)::DOUBLE AS access_score FROM accesses WHERE accessed_at >= {NOW} - 2592000000 GROUP BY target_id)"


@query("r5_signal_ranking", f"""WITH {hybrid_sql(k=40)}, {O.ACCESSES}, {_ACCESS}, {O.MARKS}, {_MARKED}, p AS (SELECT page_id, {NOW} - ({NOW} - page_id * 3600000) AS age FROM pages),
s AS (SELECT h.*, greatest(least(coalesce(mark_score, 0) + coalesce(access_score, 0), 0.55), -0.45) AS boost,
  greatest(least(CASE WHEN p.page_id IS NULL THEN 0.04 + (0.82 - 0.5) * 0.18 ELSE -0.01 + (0.58 - 0.5) * 0.18 + CASE WHEN age <= 604800000 THEN 0.08 WHEN age <= 2592000000 THEN 0.02 WHEN age <= 15552000000 THEN -0.03 ELSE -0.08 END - CASE WHEN age >= 2592000000 THEN 0.12 ELSE 0 END END::DOUBLE, 0.18), -0.18) AS signal
  FROM hits h LEFT JOIN m ON m.target_id = document_id LEFT JOIN scores a ON a.target_id = document_id LEFT JOIN p ON p.page_id = document_id),
t AS (SELECT item_id AS query_id, document_id, ordinal, score AS base, round(greatest(score + boost + signal, 0.001), 6)::DOUBLE AS score FROM s)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal))::INT AS rank FROM t QUALIFY rank <= 8""")
def r5_all(spark, d):
    """One ranking with all signals: the 40 best chunks a query, then marks, accesses, and the source's type, trust and freshness.

    A document that a page of its id was captured for is a web finding; all others are imported files.
    """
    hits = R.hybrid_scores(E.embedded_chunks(spark, d), asked(spark, d), 40).drop("rank")
    key = lambda df, c: df.withColumnRenamed(c, "document_id")
    pages = key(E.findings(spark, d).select("page_id", "retrieved_at"), "page_id")
    rows = hits.join(key(S.mark_scores(E.marks(spark, d)), "target_id"), "document_id", "left").join(key(S.access_scores(E.accesses(spark, d), NOW), "target_id"), "document_id", "left").join(pages, "document_id", "left")
    at = F.col("retrieved_at")
    kind = F.when(at.isNull(), "local_file").otherwise("web_finding")
    signal = F.coalesce(S.source_signal(kind, N.trust(kind)["score"], F.lit(None).cast("double"), at, at + 30 * 86_400_000, NOW), F.lit(0.0))
    boost = F.coalesce("mark_score", F.lit(0.0)) + F.coalesce("access_score", F.lit(0.0))
    scored = rows.select("query_id", "document_id", "ordinal", F.col("score").alias("base"), F.round(S.rescore(F.col("score"), boost, signal), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")


@query("r9_session_boost", f"""WITH turns AS (SELECT conv_id, turn, text FROM conversations), {O.embeddings('turns', 'conv_id, turn', 'te')}, {O.embeddings('benchmark', 'item_id', 'qe')}, {O.ACCESSES}, {_ACCESS}, {O.MARKS}, {_MARKED},
near AS (SELECT q.item_id, t.conv_id, t.turn, round({O.dot('q.v', 't.v')}, 6) AS base FROM qe q CROSS JOIN te t WHERE round({O.dot('q.v', 't.v')}, 6) > 0 QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY base DESC, t.conv_id, t.turn) <= 40),
s AS (SELECT coalesce(m.target_id, a.target_id) AS target_id, round(coalesce(mark_score, 0) + coalesce(access_score, 0), 6) AS session_score FROM m FULL JOIN scores a ON a.target_id = m.target_id),
t AS (SELECT item_id AS query_id, conv_id AS session_id, turn, base, round(greatest(base + greatest(least(coalesce(session_score, 0), 0.55), -0.45), 0.001), 6)::DOUBLE AS score FROM near LEFT JOIN s ON target_id = conv_id)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id, turn))::INT AS rank FROM t QUALIFY rank <= 8""")
def r9(spark, d):
    """Turns of chats for each query: the 40 nearest by similarity, ranked with the attention of their sessions as part of the boost."""
    turns = E.messages(spark, d).select(F.col("session_id").alias("document_id"), F.col("turn").cast("int").alias("ordinal"), F.col("content").alias("text"))
    near = R.nearest(turns, asked(spark, d), 40).drop("rank")
    attention = S.session_scores(E.marks(spark, d), E.accesses(spark, d), NOW).withColumnRenamed("target_id", "document_id")
    session = F.coalesce("session_score", F.lit(0.0))
    rows = near.join(attention, "document_id", "left").withColumn("total", F.round(S.rescore(F.col("score"), session, F.lit(0.0)), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("total"), "document_id", "ordinal")
    best = rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")
    return best.select("query_id", F.col("document_id").alias("session_id"), F.col("ordinal").cast("long").alias("turn"), F.col("score").alias("base"), F.col("total").alias("score"), "rank")


def passages(chunks):
    """A chunk as a passage: ids, place, anchor and an excerpt of at most 360 characters."""
    chunk = F.concat_ws(":", F.lit("chunk"), "document_id", "ordinal")
    return chunks.select("document_id", "ordinal", chunk.alias("chunk_id"), F.concat(chunk, F.lit(":anchor")).alias("anchor_id"), "start", "end", F.substring("text", 1, 360).alias("excerpt"))


_PASSAGE = """SELECT document_id, ordinal, 'chunk:' || document_id || ':' || ordinal AS chunk_id, 'chunk:' || document_id || ':' || ordinal || ':anchor' AS anchor_id, start, "end", substring(text, 1, 360) AS excerpt FROM chunks"""


@query("x2_passages", f'WITH {O.CHUNKS} SELECT document_id, ordinal, chunk_id, anchor_id, start, "end", md5(excerpt) AS excerpt_digest FROM ({_PASSAGE})')
def x2(spark, d):
    return passages(E.chunks(spark, d)).withColumn("excerpt_digest", F.md5("excerpt")).drop("excerpt")


@query("x3_context_snippets", f"""WITH {hybrid_sql()}, p AS ({_PASSAGE}) SELECT item_id AS query_id, rank::INT AS rank, 'memory_search:' || chunk_id AS snippet_id, anchor_id, score, md5(excerpt) AS excerpt_digest FROM hits JOIN p USING (document_id, ordinal)""")
def x3(spark, d):
    """Retrieval as context snippets: the few hits meet their documents, and only their passages are cut."""
    hits = R.hybrid_scores(E.embedded_chunks(spark, d), asked(spark, d), 8)
    found = snippets(spark, d, hits)
    return found.select("query_id", "rank", F.concat(F.lit("memory_search:"), "chunk_id").alias("snippet_id"), "anchor_id", "score", F.md5("excerpt").alias("excerpt_digest"))


def snippets(spark, d, hits):
    """Hits (document_id, ordinal, ...) with their passages."""
    docs = E.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    n = F.least(F.length("text"), F.lit(T.MAX_DOCUMENT_CHARS))
    start = F.col("ordinal") * T.CHUNK_STRIDE
    end = F.least(n, start + T.CHUNK_CHARS)
    cut = hits.join(docs, "document_id").withColumn("start", start).withColumn("end", end).withColumn("text", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return cut.join(passages(cut.select("document_id", "ordinal", "start", "end", "text")).distinct().drop("start", "end"), ["document_id", "ordinal"])


_LAST = "SELECT conv_id AS item_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id"


@query("b5_chat_context", f"""WITH {hybrid_sql(_LAST)}, turns AS (SELECT conv_id, turn, text FROM conversations), {O.embeddings('turns', 'conv_id, turn', 'te')}, last AS ({_LAST}),
hot AS (SELECT q.item_id, t.conv_id AS document_id, t.turn AS ordinal, round({O.dot('q.v', 't.v')}, 6) AS score FROM qe q JOIN last l ON l.item_id = q.item_id JOIN te t ON NOT (t.conv_id = l.item_id AND t.turn = l.turn) WHERE round({O.dot('q.v', 't.v')}, 6) > 0 QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY score DESC, t.conv_id, t.turn) <= 8),
both_ AS (SELECT item_id, 'chat' AS source, document_id, ordinal, score + 0.35 + 0.4 + 1.5 AS score FROM hot UNION ALL SELECT item_id, 'memory', document_id, ordinal, score + 1.5 FROM hits)
SELECT item_id AS session_id, source, document_id, ordinal, round(score, 6) AS score, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, source, document_id, ordinal))::INT AS rank FROM both_ QUALIFY rank <= 8""")
def b5(spark, d):
    """Context of each session's last user turn: turns of all chats by similarity plus 0.35 and their hotness, and retrieved chunks."""
    m = E.messages(spark, d)
    last = m.filter("role = 'user'").groupBy("session_id").agg(F.max_by("content", "turn").alias("text"), F.max("turn").alias("turn"))
    queries = last.select(F.col("session_id").alias("query_id"), "text")
    turns = m.select(F.col("session_id").alias("document_id"), F.col("turn").cast("int").alias("ordinal"), F.col("content").alias("text"))
    own = last.select(F.col("session_id").alias("query_id"), F.col("session_id").alias("document_id"), F.col("turn").cast("int").alias("ordinal"))
    # The asking turn itself may be among the nearest, so one more is looked for.
    near = R.nearest(turns, queries, 9).join(own, ["query_id", "document_id", "ordinal"], "left_anti")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "ordinal")
    hot = near.withColumn("rank", F.row_number().over(first)).filter("rank <= 8").select("query_id", F.lit("chat").alias("source"), "document_id", "ordinal", (F.col("score") + 0.35 + 0.4 + 1.5).alias("score"))
    found = R.hybrid_scores(E.embedded_chunks(spark, d), queries, 8).select("query_id", F.lit("memory").alias("source"), "document_id", "ordinal", (F.col("score") + 1.5).alias("score"))
    both = hot.union(found).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "document_id", "ordinal")
    return both.withColumn("rank", F.row_number().over(order)).filter("rank <= 8").withColumnRenamed("query_id", "session_id")
