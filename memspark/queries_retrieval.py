"""Queries on routing, retrieval, signals and their evaluation (R, A, C, I, N, M rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import text as T
from memspark.functions import vector as V
from memspark.operators import regions as G
from memspark.operators import retrieval as R
from memspark.operators import signals as S
from memspark.plans import entities as E
from memspark.registry import query

NOW = E.NOW_MS
K = 8

def hybrid_sql(asked: str = "SELECT item_id, text FROM benchmark", k: int = K) -> str:
    """CTEs up to hits(item_id, document_id, ordinal, score, rank) for a query set (item_id, text)."""
    return f"""{O.CHUNKS}, {O.embeddings('chunks', 'document_id, ordinal')},
asked AS (SELECT item_id, text, {O.tokens('text')} AS q FROM ({asked})), {O.embeddings('asked', 'item_id', 'qe')},
qtok AS (SELECT item_id, tok, count(*) AS uses FROM (SELECT item_id, unnest(q) AS tok FROM asked) GROUP BY ALL),
ctok AS (SELECT DISTINCT document_id, ordinal, tok FROM emb_tok),
lex AS (SELECT item_id, document_id, ordinal, sum(uses)::DOUBLE / any_value(len(q)) AS lex FROM ctok JOIN qtok USING (tok) JOIN asked USING (item_id) GROUP BY ALL),
scored AS (SELECT q.item_id, c.document_id, c.ordinal, coalesce(lex, 0) AS lex, {O.dot('q.v', 'c.v')} AS cos FROM qe q CROSS JOIN emb c LEFT JOIN lex l ON l.item_id = q.item_id AND l.document_id = c.document_id AND l.ordinal = c.ordinal),
final AS (SELECT item_id, document_id, ordinal, round(greatest(0.7 * cos + 0.3 * lex, CASE WHEN lex > 0 THEN greatest(lex, 0.05) ELSE 0 END), 6) AS score FROM scored),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id, ordinal) AS rank FROM final WHERE score > 0 QUALIFY rank <= {k})"""


_HYBRID = hybrid_sql()


def asked(spark: SparkSession, d: str) -> DataFrame:
    return E.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("r4_hybrid_retrieval", f"WITH {_HYBRID} SELECT item_id AS query_id, rank::INT AS rank, document_id, ordinal, score FROM hits")
def r4(spark, d):
    hits = R.hybrid_scores(E.embedded_chunks(spark, d), asked(spark, d), K)
    return hits.select("query_id", "rank", "document_id", "ordinal", "score")


def expected(spark: SparkSession, d: str) -> DataFrame:
    """Items contained verbatim in documents."""
    found = R.contained(E.read(spark, d, "documents"), E.read(spark, d, "benchmark"))
    return found.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("document_id"))


_EXPECTED = "expected AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("a17_ranking_evaluation", f"""WITH {_HYBRID}, {_EXPECTED}, f AS (SELECT hits.item_id AS item_id, min(rank) AS first FROM hits JOIN expected ON hits.item_id = expected.item_id AND hits.document_id = expected.doc_id GROUP BY hits.item_id)
SELECT count(*) AS queries, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM (SELECT DISTINCT item_id FROM expected) LEFT JOIN f USING (item_id)""")
def a17(spark, d):
    hits = R.hybrid_scores(E.embedded_chunks(spark, d), asked(spark, d), K)
    return R.evaluate(hits, expected(spark, d))


@query("j20_expected_documents", f"WITH {_EXPECTED} SELECT item_id AS query_id, doc_id AS document_id FROM expected")
def j20(spark, d):
    return expected(spark, d)


@query("o4_lexical_hits", f"""WITH {O.CHUNKS}, q AS (SELECT item_id, tok, count(*) AS uses FROM (SELECT item_id, unnest({O.tokens('text')}) AS tok FROM benchmark) GROUP BY ALL), n AS (SELECT item_id, sum(uses) AS size FROM q GROUP BY ALL),
c AS (SELECT DISTINCT document_id, ordinal, unnest({O.tokens('text')}) AS tok FROM chunks),
s AS (SELECT item_id, document_id, ordinal, round(sum(uses)::DOUBLE / any_value(size), 6) AS score FROM c JOIN q USING (tok) JOIN n USING (item_id) GROUP BY ALL)
SELECT item_id AS query_id, document_id, ordinal, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id, ordinal))::INT AS rank FROM s QUALIFY rank <= 5""")
def o4(spark, d):
    return R.lexical_hits(E.chunks(spark, d), asked(spark, d), 5)


@query("a10_attention_scores", f"WITH {O.MARKS} SELECT target_id, round(sum({O.MARK_DELTA}), 6)::DOUBLE AS mark_score FROM marks GROUP BY target_id")
def a10(spark, d):
    return S.mark_scores(E.marks(spark, d))


_AGE = f"(greatest({NOW} - accessed_at, 0) / 604800000::DOUBLE)"
_ACCESS = f"scores AS (SELECT target_id, round(least(0.6, sum(({O.ACCESS_WEIGHT})::DOUBLE * CASE WHEN {_AGE} >= 1 THEN 0.25::DOUBLE ELSE 0.45::DOUBLE + 0.55::DOUBLE * (1 - {_AGE}) END)), 6)::DOUBLE AS access_score, count(*) AS accesses FROM accesses WHERE accessed_at >= {NOW} - 2592000000 GROUP BY target_id)"


@query("a11_access_scores", f"WITH {O.ACCESSES}, {_ACCESS} SELECT * FROM scores")
def a11(spark, d):
    return S.access_scores(E.accesses(spark, d), NOW)


@query("r5_recall_rescore", f"""WITH {O.ACCESSES}, {_ACCESS}, {O.MARKS}, m AS (SELECT target_id, round(sum({O.MARK_DELTA}), 6)::DOUBLE AS mark_score FROM marks GROUP BY target_id)
SELECT doc_id, round(greatest(0.3 + greatest(least(coalesce(mark_score, 0) + coalesce(access_score, 0), 0.55), -0.45) + 0.04, 0.001), 6) AS score FROM documents LEFT JOIN m ON m.target_id = doc_id LEFT JOIN scores s ON s.target_id = doc_id""")
def r5(spark, d):
    docs = E.read(spark, d, "documents").select(F.col("doc_id").alias("target_id"))
    rows = docs.join(S.mark_scores(E.marks(spark, d)), "target_id", "left").join(S.access_scores(E.accesses(spark, d), NOW), "target_id", "left")
    boost = F.coalesce("mark_score", F.lit(0.0)) + F.coalesce("access_score", F.lit(0.0))
    return rows.select(F.col("target_id").alias("doc_id"), F.round(S.rescore(F.lit(0.3), boost, F.lit(0.04)), 6).alias("score"))


@query("r6_source_signal", f"""WITH {O.FINDINGS} SELECT page_id, round(greatest(least(-0.01 + 0.08 * 0.18 + (CASE WHEN page_id % 2 = 0 THEN 0.9 ELSE 0.2 END - 0.5) * 0.12 + CASE WHEN a <= 604800000 THEN 0.08 WHEN a <= 2592000000 THEN 0.02 WHEN a <= 15552000000 THEN -0.03 ELSE -0.08 END - CASE WHEN a >= 2592000000 THEN 0.12 ELSE 0 END, 0.18), -0.18), 6)::DOUBLE AS signal FROM (SELECT page_id, {NOW} - retrieved_at AS a FROM findings)""")
def r6(spark, d):
    f = E.findings(spark, d)
    at = F.col("retrieved_at")
    conf = F.when(F.col("page_id") % 2 == 0, 0.9).otherwise(0.2)
    return f.select("page_id", F.round(S.source_signal(F.lit("web_finding"), F.lit(0.58), conf, at, at + 2_592_000_000, NOW), 6).alias("signal"))


def regions_sql(rows: str, tie: str = "document_id") -> str:
    """CTEs from e (family, document_id, ..., embedding) to regions with a region number; tie tells rows apart."""
    dot = "list_inner_product"
    near = f"CASE WHEN {dot}(c.embedding, c.embedding) * {dot}(s.embedding, s.embedding) = 0 THEN 0 ELSE round({dot}(c.embedding, s.embedding) / (sqrt({dot}(c.embedding, c.embedding)) * sqrt({dot}(s.embedding, s.embedding))), 6) END"
    parts = [f"e AS ({rows})", "k AS (SELECT family, least(4, ceil(sqrt(count(*))))::INT AS k FROM e GROUP BY family)", f"seed0 AS (SELECT family, arg_min(embedding, ({tie}, 0)) AS embedding FROM e GROUP BY family)", f"r0 AS (SELECT c.*, {near} AS s0 FROM e c JOIN seed0 s USING (family))"]
    for i in range(1, 4):
        seen = "greatest(" + ", ".join(f"coalesce(s{j}, -2)" for j in range(i)) + ")"
        parts.append(f"seed{i} AS (SELECT family, arg_min(embedding, ({seen}, {tie})) AS embedding FROM r{i - 1} JOIN k USING (family) WHERE k > {i} GROUP BY family)")
        parts.append(f"r{i} AS (SELECT c.*, CASE WHEN s.embedding IS NOT NULL THEN {near} END AS s{i} FROM r{i - 1} c LEFT JOIN seed{i} s USING (family))")
    best = ", ".join(f"coalesce(s{j}, -2)" for j in range(4))
    parts.append(f"regions AS (SELECT * EXCLUDE (s0, s1, s2, s3), (list_position([{best}], greatest({best})) - 1)::INT AS region FROM r3)")
    return ",\n".join(parts)


_REGIONS = regions_sql("SELECT 'l' || label AS family, vec_id AS document_id, embedding::DOUBLE[] AS embedding FROM embeddings")
#: All chunks with their vectors, zero ones included.
ALL_VECTORS = "SELECT family, document_id, ordinal, text, coalesce(v, [0::DOUBLE for i in range(64)]) AS embedding FROM chunks LEFT JOIN emb USING (document_id, ordinal)"
_CHUNK_REGIONS = f"{O.CHUNKS}, {O.embeddings('chunks', 'document_id, ordinal')}, {regions_sql(ALL_VECTORS, 'document_id, ordinal')}"
_WHOLE_CHUNK_REGIONS = _CHUNK_REGIONS.replace(O.CHUNKS, O.WHOLE_CHUNKS)


def label_regions(spark: SparkSession, d: str) -> DataFrame:
    e = E.read(spark, d, "embeddings").select(F.concat(F.lit("l"), "label").alias("family"), F.col("vec_id").alias("document_id"), F.lit(0).alias("ordinal"), F.col("embedding").cast("array<double>").alias("embedding"))
    return G.assign_regions(e)


@query("c3_vector_regions", f"WITH {_REGIONS} SELECT family, document_id AS vec_id, region FROM regions")
def c3(spark, d):
    return label_regions(spark, d).select("family", F.col("document_id").alias("vec_id"), "region")


@query("c3_chunk_regions", f"WITH {_WHOLE_CHUNK_REGIONS} SELECT family, region, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM regions GROUP BY ALL")
def c3_chunks(spark, d):
    """The same over the hash embeddings of all chunks of whole texts."""
    return G.assign_regions(E.embedded_chunks(spark, d, T.WHOLE, T.WHOLE).drop("text")).groupBy("family", "region").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


@query("c8_region_neighbours", f"""WITH {_REGIONS}, x AS (SELECT family, region, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM regions), m AS (SELECT family, region, i, avg(x) AS c FROM x GROUP BY ALL),
p AS (SELECT a.family, a.region, b.region AS neighbour, round(sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))), 4) AS score FROM m a JOIN m b ON a.family = b.family AND a.i = b.i AND a.region <> b.region GROUP BY ALL)
SELECT family, region, neighbour, score, (row_number() OVER (PARTITION BY family, region ORDER BY score DESC, neighbour))::INT AS rank FROM p QUALIFY rank <= 3""")
def c8(spark, d):
    r = label_regions(spark, d)
    cards = r.groupBy("family", "region").agg(V.mean_vector(F.col("embedding")).alias("centroid"))
    return G.neighbours(cards)


@query("c6_region_cards", f"""WITH {_CHUNK_REGIONS}, terms AS (SELECT family, region, term, row_number() OVER (PARTITION BY family, region ORDER BY count(*) DESC, term) AS n FROM (SELECT family, region, unnest({O.tokens('text')}) AS term FROM regions) WHERE term NOT IN {O.STOP} GROUP BY family, region, term QUALIFY n <= 3),
named AS (SELECT family, region, string_agg(term, ' / ' ORDER BY n) AS terms FROM terms GROUP BY ALL), sizes AS (SELECT family, region, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM regions GROUP BY ALL)
SELECT family, region, chunks, documents, left(upper(family[1]) || family[2:] || ': ' || coalesce(terms, 'memory'), 72) AS label, 'Hierarchical source-aware region with semantic terms ' || coalesce(terms, 'memory') || '; source type ' || family AS summary FROM sizes LEFT JOIN named USING (family, region)""")
def c6(spark, d):
    """Regions of all chunks with label, summary and size."""
    return G.region_cards(G.assign_regions(E.embedded_chunks(spark, d))).select("family", "region", "chunks", "documents", "label", "summary")


@query("r1_map_routing", f"""WITH t AS (SELECT item_id, unnest({O.tokens('text')}) AS tok FROM benchmark),
card AS (SELECT lang AS region_id, lower('Language ' || lang || ' documents') AS label, lower(string_agg(DISTINCT source, ' ' ORDER BY source)) AS vals FROM documents GROUP BY lang),
s AS (SELECT item_id, region_id, sum(CASE WHEN contains(label, tok) THEN 2.0 ELSE 0 END + CASE WHEN contains(vals, tok) THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM t, card GROUP BY ALL)
SELECT item_id AS query_id, region_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, region_id))::INT AS rank FROM s QUALIFY rank <= 3""")
def r1(spark, d):
    """A map of languages is a small table of regions: it is gathered into one row and met by every query."""
    docs = E.read(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), " ").alias("vals")).filter("lang is not null")
    cards = docs.select(F.struct(F.col("lang").alias("region_id"), F.concat(F.lit("Language "), F.col("lang"), F.lit(" documents")).alias("label"), F.create_map(F.lit("sources"), F.col("vals")).alias("filters")).alias("card"))
    entries = [F.struct(F.lit(r["card"]["region_id"]).alias("region_id"), F.lit(r["card"]["label"]).alias("label"), F.lit(r["card"]["filters"]["sources"]).alias("vals")) for r in cards.orderBy("card.region_id").collect()]  # one row a language
    asks = asked(spark, d).withColumn("tokens", T.tokenize(F.col("text"))).filter(F.size("tokens") > 0)
    if not entries:
        return asks.select("query_id", F.lit("").alias("region_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    met = asks.select("query_id", "tokens", F.explode(F.array(*entries)).alias("e"))
    scored = met.select("query_id", "e.region_id", R.route_score(F.col("tokens"), F.col("e.label"), F.lit(""), F.create_map(F.lit("sources"), F.col("e.vals"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "region_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")


_MAP = "SELECT source AS region_id, 'Documents of ' || source AS label, count(*) AS documents FROM documents GROUP BY source"


@query("m1_route_map", f"""WITH e AS ({_MAP}), j AS (SELECT region_id, label, documents, row_number() OVER (ORDER BY region_id) AS k, strlen('{{"region_id":"' || region_id || '","label":"' || label || '","documents":' || documents || '}}') + 1 AS size FROM e),
c AS (SELECT *, sum(size) OVER (ORDER BY k) + 1 AS total FROM j) SELECT region_id, label, documents, total::BIGINT AS bytes FROM c WHERE total <= 2048 OR k <= 3""")
def m1(spark, d):
    """Entries by id while their JSON fits 2048 bytes (three at least): a prefix sum over one row a source."""
    e = E.read(spark, d, "documents").groupBy(F.col("source").alias("region_id")).agg(F.count("*").alias("documents")).filter("region_id is not null").withColumn("label", F.concat(F.lit("Documents of "), "region_id"))
    e = e.withColumn("size", F.octet_length(F.to_json(F.struct("region_id", "label", "documents"))) + 1)
    head = e.orderBy("region_id").limit(2048)  # an entry has more than one byte, so no more than these can fit
    w = Window.orderBy("region_id")
    placed = head.withColumn("k", F.row_number().over(w)).withColumn("bytes", F.sum("size").over(w) + 1)
    return placed.filter("bytes <= 2048 or k <= 3").select("region_id", "label", "documents", "bytes")


@query("n5_expand_window", f'WITH {O.CHUNKS} SELECT c.document_id, c.ordinal, md5(substring(d.text, greatest(c.start - 220, 0) + 1, least(c."end" + 220, length(d.text)) - greatest(c.start - 220, 0))) AS window_digest FROM chunks c JOIN (SELECT doc_id, left(text, 250000) AS text FROM documents) d ON d.doc_id = c.document_id')
def n5(spark, d):
    """A chunk with 220 characters on either side; windows are cut while the document is at hand."""
    docs = E.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.substring("text", 1, T.MAX_DOCUMENT_CHARS).alias("text"))
    c = docs.select("document_id", "text", F.explode(T.chunk_structs(F.col("text"))).alias("c"))
    return c.select("document_id", "c.ordinal", F.md5(T.excerpt(F.col("text"), F.col("c.start"), F.col("c.end"), 220)).alias("window_digest"))


@query("n9_trust_policy", """SELECT 'document:' || doc_id AS node, CASE WHEN good THEN 0.95 ELSE 0.82 END::DOUBLE AS trust, 'imported_document' AS kind FROM documents LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good FROM labels GROUP BY doc_id) USING (doc_id)
UNION ALL SELECT 'page:' || page_id, 0.58, 'web_finding' FROM pages UNION ALL SELECT DISTINCT 'session:' || conv_id, 0.70, 'chat_transcript' FROM conversations
UNION ALL SELECT 'memory:' || conv_id || ':' || turn, 0.35, 'generated_summary' FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'vector:' || vec_id, 0.5, 'unknown' FROM embeddings""")
def n9(spark, d):
    """Trust of documents, captured pages, chats, memories that answers left, and vectors of no known source; a good label overrides the default."""
    from memspark.operators.navigation import trust

    none = F.lit(None).cast("double")
    good = E.read(spark, d, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"))
    chats = E.messages(spark, d)
    named = lambda df, kind, source, *parts, override=none: df.select(F.concat_ws(":", F.lit(kind), *parts).alias("node"), F.lit(source).alias("source_type"), override.alias("override"))
    rows = named(E.read(spark, d, "documents").join(good, "doc_id", "left"), "document", "local_file", "doc_id", override=F.when(F.col("good"), 0.95))
    rows = rows.union(named(E.read(spark, d, "pages"), "page", "web_finding", "page_id")).union(named(chats.select("session_id").distinct(), "session", "chat", "session_id"))
    rows = rows.union(named(chats.filter("role = 'assistant'"), "memory", "derived_memory", "session_id", "turn")).union(named(E.read(spark, d, "embeddings"), "vector", "vector", "vec_id"))
    return rows.select("node", trust(F.col("source_type"), F.col("override")).alias("t")).select("node", F.col("t.score").alias("trust"), "t.kind")


@query("n10_first_passages", f'WITH {O.CHUNKS} SELECT document_id, ordinal, start, "end" FROM chunks WHERE ordinal < 5')
def n10(spark, d):
    from memspark.operators.navigation import first_passages

    return first_passages(E.chunk_spans(spark, d)).select("document_id", "ordinal", "start", "end")


@query("i7_representatives", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY ALL),
s AS (SELECT label, vec_id, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 4) AS score FROM e JOIN m USING (label, i) GROUP BY ALL)
SELECT label, vec_id, score, (row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id))::INT AS rank FROM s QUALIFY rank <= 8""")
def i7(spark, d):
    e = E.read(spark, d, "embeddings")
    means = e.groupBy("label").agg(V.mean_vector(F.col("embedding")).alias("c"))
    s = e.join(means, "label").select("label", "vec_id", F.round(V.cosine("embedding", "c"), 4).alias("score"))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return s.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")
