"""Queries on text, time, hash and vector functions (F, D, H, V, P, A, W rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import hashing as H
from memspark.functions import pages as P
from memspark.functions import privacy as S
from memspark.functions import text as T
from memspark.functions import timefx as D
from memspark.functions import vector as V
from memspark.plans import entities as E
from memspark.registry import query

NOW = E.NOW_MS


def docs(spark: SparkSession, d: str) -> DataFrame:
    return E.read(spark, d, "documents")


@query("f1_tokenize", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, coalesce(t[1], '') AS first_token, coalesce(t[-1], '') AS last_token FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents)")
def f1(spark, d):
    t = docs(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"), F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).alias("last_token"))


@query("f2_lexical_overlap", f"SELECT item_id, len(q)::BIGINT AS tokens, round(len(list_filter(q, lambda x: list_contains(h, x)))::DOUBLE / len(q), 6) AS overlap FROM (SELECT item_id, {O.tokens('text')} AS q, {O.tokens('left(text, 80)')} AS h FROM benchmark) WHERE len(q) > 0")
def f2(spark, d):
    b = E.read(spark, d, "benchmark").select("item_id", T.tokenize(F.col("text")).alias("q"), T.tokenize(F.substring("text", 1, 80)).alias("h")).filter(F.size("q") > 0)
    return b.select("item_id", F.size("q").cast("long").alias("tokens"), F.round(T.lexical_overlap(F.col("q"), F.col("h")), 6).alias("overlap"))


@query("f3_chunk_text", f'WITH {O.CHUNKS} SELECT document_id, ordinal, start, "end", md5(text) AS digest FROM chunks')
def f3(spark, d):
    return E.chunks(spark, d).select("document_id", "ordinal", "start", "end", F.md5("text").alias("digest"))


@query("f4_excerpt", """SELECT item_id, substring(text, 41, 200) AS excerpt, substring(text, 1, 160) AS head FROM benchmark""")
def f4(spark, d):
    return E.read(spark, d, "benchmark").select("item_id", T.excerpt(F.col("text"), F.lit(100), F.lit(180), 60).alias("excerpt"), T.excerpt(F.col("text"), F.lit(0), F.lit(100), 60).alias("head"))


@query("f5_byte_offset", "SELECT doc_id, strlen(left(text, 100))::INT AS at_100, strlen(text)::INT AS at_end FROM documents")
def f5(spark, d):
    return docs(spark, d).select("doc_id", T.byte_offset(F.col("text"), F.lit(100)).alias("at_100"), T.byte_offset(F.col("text"), F.length("text")).alias("at_end"))


@query("f6_slugify", "SELECT doc_id, regexp_replace(lower(regexp_replace(left(text, 80), '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS slug FROM documents")
def f6(spark, d):
    return docs(spark, d).select("doc_id", T.slugify(F.substring("text", 1, 80)).alias("slug"))


@query("f7_normalize_segment", r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS digest FROM documents")
def f7(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalize_segment(F.col("text"))).alias("digest"))


@query("f8_collapse_whitespace", f"SELECT doc_id, length({O.collapse('text')}) AS size, md5({O.collapse('text')}) AS digest FROM documents")
def f8(spark, d):
    c = T.collapse(F.col("text"))
    return docs(spark, d).select("doc_id", F.length(c).cast("long").alias("size"), F.md5(c).alias("digest"))


@query("f9_bounded_text", f"SELECT doc_id, CASE WHEN length(x) > 320 THEN left(x, 320) || '...' ELSE x END AS bounded FROM (SELECT doc_id, {O.collapse('text')} AS x FROM documents)")
def f9(spark, d):
    return docs(spark, d).select("doc_id", T.bounded(F.col("text")).alias("bounded"))


@query("f11_chunk_label", rf"SELECT doc_id, left(CASE WHEN l = '' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE l END, 72) AS label FROM (SELECT doc_id, text, regexp_replace({O.collapse('text')}, '^[^\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+$', '', 'g') AS l FROM documents)")
def f11(spark, d):
    return docs(spark, d).select("doc_id", T.chunk_label(F.col("text")).alias("label"))


_LINES = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k"


@query("f14_paragraph_spans", rf"""WITH l AS (SELECT doc_id, {_LINES} FROM documents WHERE text <> ''),
p AS (SELECT doc_id, k, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1)::BIGINT AS start FROM l),
q AS (SELECT * FROM p WHERE regexp_replace(line, '\s+', '', 'g') <> '')
SELECT doc_id, count(*) AS paragraphs, max(start + length(line))::BIGINT AS last_end, sum(start)::BIGINT AS starts FROM q GROUP BY doc_id""")
def f14(spark, d):
    """Lines as rows: offsets are running sums of the lengths before (W6)."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).filter(T.strip(F.col("line")) != "")
    return placed.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.col("start") + F.length("line")).alias("last_end"), F.sum("start").alias("starts"))


@query("f12_heading_label", r"""WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<h([1-6])[^>]*>', chr(10) || '# ', 'g'), chr(10))) AS line FROM pages)
SELECT page_id, count(*) AS headings, min(left(trim(regexp_extract(trim(line), '^#+\s(.*)$', 1)), 96)) AS first_label FROM l WHERE regexp_matches(trim(line), '^#+\s+\S') GROUP BY page_id""")
def f12(spark, d):
    """Heading elements of pages as Markdown headings, then their labels."""
    lines = E.read(spark, d, "pages").select("page_id", F.explode(F.split(F.regexp_replace("html", "<h([1-6])[^>]*>", "\n# "), "\n")).alias("line"))
    return lines.select("page_id", T.heading(F.col("line")).alias("h")).filter("h is not null").groupBy("page_id").agg(F.count("*").alias("headings"), F.min("h.label").alias("first_label"))


@query("f16_parse_citations", r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents),
m AS (SELECT doc_id, CASE WHEN starts_with(w, 'cite:') THEN substr(w, 6) ELSE substr(w, 2) END AS raw FROM w WHERE starts_with(w, 'cite:') OR starts_with(w, '@')
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?s)cite\((.*?)\)', 1)) FROM documents
UNION ALL SELECT doc_id, regexp_replace(trim(unnest(regexp_split_to_array(g, '[;,]'))), '^@+', '') FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)\[@(.*?)\]', 1)) AS g FROM documents)),
c AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(raw), '^[^\p{L}\p{M}\p{N}_/-]+|[^\p{L}\p{M}\p{N}_/-]+$', '', 'g'), '(\.md)+$', ''), '(\.markdown)+$', '') AS ref FROM m)
SELECT doc_id, ref FROM c WHERE ref <> ''""")
def f16(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.citations(F.col("text"))).alias("ref"))


@query("f17_markdown_links", r"""SELECT doc_id, regexp_replace(x, '^\[\[|\]\]$|^\]\(|\)$', '', 'g') AS target FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)\[\[.*?\]\]|\]\([^)]*\)')) AS x FROM documents)""")
def f17(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.markdown_links(F.col("text"))).alias("target"))


@query("f18_normalize_ref", r"SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^[/\"'']+|[/\"'']+$', '', 'g'), '(\.md)+$', ''), '(\.markdown)+$', '')), '[^a-z0-9-]', '', 'g') AS ref FROM pages")
def f18(spark, d):
    return E.read(spark, d, "pages").select("page_id", T.normalize_ref(F.col("url")).alias("ref"))


_ENTITY_STOP = O.in_list(T.ENTITY_STOP_WORDS)


@query("f19_document_entities", rf"""WITH t AS (SELECT doc_id, lower(w) AS e FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{M}}\p{{N}}_-]+')) AS w FROM documents) WHERE regexp_matches(w, '^[A-Z]+$') OR (regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '^.+[a-z]')))
SELECT doc_id, count(DISTINCT e) AS entities, min(e) AS first_entity, max(e) AS last_entity FROM t WHERE strlen(e) >= 4 AND e NOT IN {_ENTITY_STOP} GROUP BY doc_id""")
def f19(spark, d):
    e = docs(spark, d).select("doc_id", F.explode(T.entities(F.lit(""), F.col("text"))).alias("e"))
    return e.groupBy("doc_id").agg(F.count("*").alias("entities"), F.min("e").alias("first_entity"), F.max("e").alias("last_entity"))


@query("f20_overlap_score", "SELECT n, round(least(0.48 + least(n, 5) * 0.04, 0.68)::DOUBLE, 6) AS score, CASE WHEN n >= 5 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS band FROM (SELECT DISTINCT quality + toxic + 2 AS n FROM labels)")
def f20(spark, d):
    n = E.read(spark, d, "labels").select((F.col("quality") + F.col("toxic") + 2).alias("n")).distinct()
    return n.select("n", F.round(T.overlap_score(F.col("n")), 6).alias("score"), T.confidence_band(F.col("n"), 5, 3).alias("band"))


@query("f23_representative_terms", rf"SELECT doc_id, len(t)::BIGINT AS terms, t[1] AS first_term FROM (SELECT doc_id, CASE WHEN len(x) = 0 THEN ['memory'] ELSE x END AS t FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), {O.SPLIT}), lambda w: strlen(w) >= 4))) AS x FROM documents))")
def f23(spark, d):
    t = docs(spark, d).select("doc_id", T.representative_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("terms"), F.get("t", F.lit(0)).alias("first_term"))


@query("f24_entity_terms", rf"SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(text, {O.SPLIT}), lambda w: strlen(w) >= 4 AND regexp_matches(w, '^\p{{Lu}}'))))::BIGINT AS terms FROM documents")
def f24(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.entity_terms(F.col("text"))).cast("long").alias("terms"))


_SECRET = r"regexp_matches(regexp_replace(w, '^[\"''`,;:)\]}]+|[\"''`,;:)\]}]+$', '', 'g'), '^sk-') OR regexp_matches(lower(w), 'api_key|apikey|password=|secret=|token=')"


@query("f25_redact", rf"SELECT doc_id, md5(array_to_string(list_transform({O.words('text')}, lambda w: CASE WHEN {_SECRET} THEN '[REDACTED]' ELSE w END), ' ')) AS digest FROM documents")
def f25(spark, d):
    return docs(spark, d).select("doc_id", F.md5(S.redact(F.col("text"))).alias("digest"))


@query("p9_contains_secret", rf"SELECT doc_id, len(list_filter({O.words('text')}, lambda w: {_SECRET})) > 0 AS secret FROM documents")
def p9(spark, d):
    return docs(spark, d).select("doc_id", S.has_secret(F.col("text")).alias("secret"))


@query("f26_token_estimate", f"SELECT doc_id, ceil(len({O.words('text')}) * 1.35::DOUBLE)::BIGINT AS tokens FROM documents")
def f26(spark, d):
    return docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("f28_page_text", f"SELECT page_id, length(body) AS size, md5(body) AS digest FROM (SELECT page_id, {O.PAGE_TEXT} AS body FROM pages)")
def f28(spark, d):
    b = E.read(spark, d, "pages").select("page_id", P.page_text(F.col("html")).alias("b"))
    return b.select("page_id", F.length("b").cast("long").alias("size"), F.md5("b").alias("digest"))


@query("f29_url_domain", f"SELECT page_id, {O.DOMAIN} AS domain FROM pages")
def f29(spark, d):
    return E.read(spark, d, "pages").select("page_id", P.url_domain(F.col("url")).alias("domain"))


@query("f30_path_parts", r"SELECT page_id, x[-2] AS folder, x[-1] AS tail FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda p: p <> '') AS x FROM pages)")
def f30(spark, d):
    return E.read(spark, d, "pages").select("page_id", T.parent_folder(F.col("url")).alias("folder"), T.path_tail(F.col("url")).alias("tail"))


@query("f31_grep", """WITH p AS (SELECT doc_id, string_split(lower(text), 'the') AS parts FROM documents WHERE contains(lower(text), 'the')),
h AS (SELECT doc_id, unnest(range(1, len(parts))) AS k, parts FROM p)
SELECT doc_id, (k - 1)::INT AS hit, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + 3 * (k - 1))::INT AS start FROM h""")
def f31(spark, d):
    g = docs(spark, d).select("doc_id", F.posexplode(T.grep_starts(F.col("text"), F.lit("the"))).alias("hit", "start"))
    return g


@query("f34_sentence_kinds", r"""SELECT session_id, turn, sentence, CASE WHEN lower(sentence) LIKE '%decided%' OR lower(sentence) LIKE '%decision%' THEN 'decision' WHEN lower(sentence) LIKE '%todo%' OR lower(sentence) LIKE '%task%' OR lower(sentence) LIKE '%need to%' THEN 'task' WHEN lower(sentence) LIKE '%remember%' OR lower(sentence) LIKE '%fact%' THEN 'fact' ELSE 'none' END AS kind
FROM (SELECT conv_id AS session_id, turn, trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS sentence FROM conversations) WHERE sentence <> ''""")
def f34(spark, d):
    s = E.messages(spark, d).select("session_id", "turn", F.explode(F.split("content", "[.\n]")).alias("sentence")).withColumn("sentence", F.trim("sentence")).filter("sentence <> ''")
    return s.withColumn("kind", F.coalesce(T.sentence_kind(F.col("sentence")), F.lit("none")))


@query("d1_normalize_epoch", "SELECT event_id, CASE WHEN v < 10000000000 THEN v * 1000 ELSE v END AS ms FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 END AS v FROM events)")
def d1(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp_ltz"))
    v = F.when(F.col("event_id") % 2 == 0, ms).otherwise(F.floor(ms / 1000))
    return E.read(spark, d, "events").select("event_id", D.norm_ms(v).alias("ms"))


_AGE = f"({NOW} - retrieved_at)"
_DAY = f"{D.DAY}::BIGINT"


@query("d2_freshness_status", f"""WITH {O.FINDINGS} SELECT page_id, CASE WHEN retrieved_at + 30 * {_DAY} <= {NOW} THEN 'refresh_needed' WHEN {_AGE} <= 14 * {_DAY} THEN 'fresh' WHEN {_AGE} <= 60 * {_DAY} THEN 'aging' ELSE 'stale' END AS status,
CASE WHEN {_AGE} <= 7 * {_DAY} THEN 0.08 WHEN {_AGE} <= 30 * {_DAY} THEN 0.02 WHEN {_AGE} <= 180 * {_DAY} THEN -0.03 ELSE -0.08 END::DOUBLE AS signal, retrieved_at + 90 * {_DAY} < {NOW} AS training_stale FROM findings""")
def d2(spark, d):
    f = E.findings(spark, d)
    at = F.col("retrieved_at")
    return f.select("page_id", D.freshness_status(at, D.default_expiry(at), NOW).alias("status"), D.freshness_signal(at, NOW).cast("double").alias("signal"), D.training_stale(at, NOW).alias("training_stale"))


_AGE7 = f"(greatest({NOW} - accessed_at, 0) / {7 * D.DAY}::DOUBLE)"


@query("d4_recency_weight", f"WITH {O.ACCESSES} SELECT event_id, kind, round(({O.ACCESS_WEIGHT})::DOUBLE * CASE WHEN {_AGE7} >= 1 THEN 0.25::DOUBLE ELSE 0.45::DOUBLE + 0.55::DOUBLE * (1 - {_AGE7}) END, 6) AS weight FROM accesses")
def d4(spark, d):
    w = D.recency_weight(E.lookup(F.col("kind"), E.ACCESS_WEIGHTS), F.col("accessed_at"), NOW)
    return E.accesses(spark, d).select("event_id", "kind", F.round(w, 6).alias("weight"))


@query("h1_fnv1a", "SELECT item_id, lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, [('0x' || substr(hex(text), 2 * i + 1, 2))::HUGEINT for i in range(strlen(text))]), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT), 16, '0')) AS fnv FROM benchmark")
def h1(spark, d):
    return E.read(spark, d, "benchmark").select("item_id", H.fnv1a("text").alias("fnv"))


@query("h3_split", "SELECT doc_id, CASE WHEN n <= 6 THEN 'train' WHEN n = 7 THEN 'eval' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT % 10 AS n FROM documents)")
def h3(spark, d):
    return docs(spark, d).select("doc_id", H.split_name(F.col("doc_id").cast("string")).alias("split"))


@query("h4_hash_embedding", f"WITH {O.CHUNKS}, {O.embeddings('chunks', 'document_id, ordinal')} SELECT document_id, ordinal, round(v[1], 6) AS v0, round(v[33], 6) AS v32, round(list_sum(v), 4) AS total FROM emb")
def h4(spark, d):
    e = E.embedded_chunks(spark, d).select("document_id", "ordinal", "embedding").filter(F.exists("embedding", lambda x: x > 0))
    return e.select("document_id", "ordinal", F.round(F.get("embedding", F.lit(0)), 6).alias("v0"), F.round(F.get("embedding", F.lit(32)), 6).alias("v32"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("v1_cosine_to_label_mean", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY label, i)
SELECT vec_id, label, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 4) AS cosine FROM e JOIN m USING (label, i) GROUP BY vec_id, label""")
def v1(spark, d):
    e = E.read(spark, d, "embeddings")
    means = e.groupBy("label").agg(V.mean_vector(F.col("embedding")).alias("centre"))
    return e.join(means, "label").select("vec_id", "label", F.round(V.cosine("embedding", "centre"), 4).alias("cosine"))


@query("v2_unit_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS u0 FROM embeddings")
def v2(spark, d):
    return E.read(spark, d, "embeddings").select("vec_id", F.round(F.get(V.unit(F.col("embedding")), F.lit(0)), 6).alias("u0"))


@query("a4_centroids", "SELECT label, (i - 1)::INT AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def a4(spark, d):
    c = E.read(spark, d, "embeddings").groupBy("label").agg(V.mean_vector(F.col("embedding")).alias("c"))
    return c.select("label", F.posexplode("c").alias("i", "m")).select("label", "i", F.round("m", 6).alias("mean"))


@query("a1_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({O.tokens('text')}) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 5")
def a1(spark, d):
    t = docs(spark, d).select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(5)


@query("a2_cooccurrence", f"""WITH t AS (SELECT doc_id, {O.tokens('text')} AS t FROM documents), seed AS (SELECT term FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM t) GROUP BY term ORDER BY count(*) DESC, term LIMIT 1)
SELECT x AS term, count(*) AS tf FROM (SELECT unnest(t) AS x FROM t, seed WHERE list_contains(t, seed.term)), seed WHERE x <> seed.term GROUP BY x ORDER BY tf DESC, x LIMIT 3""")
def a2(spark, d):
    seed = a1(spark, d).first()
    t = docs(spark, d).select(T.tokenize(F.col("text")).alias("t"))
    if seed is None:
        return t.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")).limit(0)
    w = t.filter(F.array_contains("t", seed["term"])).select(F.explode("t").alias("term")).filter(F.col("term") != seed["term"])
    return w.groupBy("term").agg(F.count("*").alias("tf")).orderBy(F.desc("tf"), "term").limit(3)


@query("a3_top_terms", f"""WITH {O.CHUNKS}, w AS (SELECT family, unnest({O.tokens('text')}) AS term FROM chunks), c AS (SELECT family, term, count(*) AS tf FROM w WHERE term NOT IN {O.STOP} GROUP BY ALL)
SELECT family, term, tf, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY tf DESC, term) AS rank FROM c) WHERE rank <= 3""")
def a3(spark, d):
    from memspark.operators.regions import top_terms

    return top_terms(E.chunks(spark, d), ["family"]).select("family", "term", "tf", "rank")


@query("a7_count_by_source", "SELECT source, lang, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source, lang")
def a7(spark, d):
    return docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@query("a9_chunks_per_document", f"WITH {O.CHUNKS} SELECT document_id, count(*) AS chunks FROM chunks GROUP BY document_id")
def a9(spark, d):
    """Counted from lengths alone: no chunk is built."""
    return docs(spark, d).filter(F.length("text") > 0).groupBy(F.col("doc_id").alias("document_id")).agg(F.sum(T.chunk_count(F.col("text"))).alias("chunks"))


@query("a18_unique_or_mixed", "SELECT source, CASE count(DISTINCT lang) WHEN 0 THEN NULL WHEN 1 THEN min(lang) ELSE 'mixed' END AS lang FROM documents GROUP BY source")
def a18(spark, d):
    n = F.countDistinct("lang")
    return docs(spark, d).groupBy("source").agg(F.when(n == 1, F.min("lang")).when(n > 1, "mixed").alias("lang"))


@query("a20_unique_values", "SELECT source, array_to_string(list_sort(list(DISTINCT trim(lang))), ',') AS langs FROM documents WHERE trim(lang) <> '' GROUP BY source")
def a20(spark, d):
    return docs(spark, d).filter(F.trim("lang") != "").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.trim("lang"))), ",").alias("langs"))


@query("a28_table_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def a28(spark, d):
    parts = [E.read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "embeddings", "pages", "events", "conversations", "labels", "benchmark")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("p2_soft_delete", "SELECT doc_id, toxic = 1 AS deleted FROM labels")
def p2(spark, d):
    lab = E.read(spark, d, "labels")
    chunk = F.when(F.col("toxic") == 1, F.create_map(F.lit("deletion_state"), F.lit("deleted"))).otherwise(F.create_map(F.lit("deletion_state"), F.lit("live")))
    doc = F.create_map(F.lit("deletion_state"), F.lit("deleted"))
    return lab.select("doc_id", S.deleted(chunk, doc).alias("deleted"))


@query("p1_metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def p1(spark, d):
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return docs(spark, d).select("doc_id", "lang", "source").filter(S.matches_filters(meta, {"lang": "en", "source": "src1"})).select("doc_id")


@query("p4_lossy_cast", "SELECT event_id, try_cast(props->>'$.k' AS DOUBLE) AS k FROM events")
def p4(spark, d):
    return E.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("p7_truthy", "SELECT doc_id, quality = 1 AS yes FROM labels")
def p7(spark, d):
    return E.read(spark, d, "labels").select("doc_id", S.truthy(F.concat(F.lit(" "), F.col("quality").cast("string"))).alias("yes"))


@query("p11_privacy_level", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'shared_project_memory' WHEN source = 'src2' THEN 'excluded_from_adapter_training' ELSE 'private_user_memory' END AS level FROM documents")
def p11(spark, d):
    raw = F.when(F.col("source").isin("src0", "src1"), " Shared ").when(F.col("source") == "src2", "EXCLUDED").otherwise(F.col("source"))
    return docs(spark, d).select("doc_id", S.privacy_level(raw).alias("level"))


@query("p12_node_ref", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'chunk' END AS kind, CASE WHEN lang = 'en' THEN doc_id::VARCHAR || ':0' END AS id FROM documents")
def p12(spark, d):
    ref = F.when(F.col("lang") == "en", F.concat(F.lit("chunk:"), F.col("doc_id"), F.lit(":0"))).otherwise(F.concat(F.lit("page:"), F.col("doc_id")))
    r = docs(spark, d).select("doc_id", S.node_ref(ref).alias("r"))
    return r.select("doc_id", "r.kind", "r.id")


@query("p14_table_listing", f"SELECT conv_id, turn, list_has_any({O.tokens('text')}, ['list','show','display','all','who']) AND list_has_any({O.tokens('text')}, ['employee','employees','people','contacts','users','customers','accounts','rows','records']) AS listing FROM conversations")
def p14(spark, d):
    return E.read(spark, d, "conversations").select("conv_id", "turn", S.table_listing_request(T.tokenize(F.col("text"))).alias("listing"))


@query("s2_accepted_files", f"SELECT page_id, e = '' OR e IN {O.in_list(T.EXTENSIONS)} AS accepted FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([^./]+)$', 1)) AS e FROM pages)")
def s2(spark, d):
    return E.read(spark, d, "pages").select("page_id", T.accepted_file(F.regexp_replace("url", "[?#].*$", "")).alias("accepted"))


@query("w5_section_spans", r"""WITH l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k, length(t) AS n FROM (SELECT page_id, regexp_replace(html, '<h([1-6])[^>]*>', chr(10) || '# ', 'g') AS t FROM pages)),
p AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY k) - length(line) - 1)::INT AS start FROM l)
SELECT page_id, start, coalesce(lead(start) OVER (PARTITION BY page_id ORDER BY k), n)::INT AS "end", left(trim(regexp_extract(trim(line), '^#+\s(.*)$', 1)), 96) AS label FROM p WHERE regexp_matches(trim(line), '^#+\s+\S')""")
def w5(spark, d):
    """A heading's section ends where the next one starts."""
    t = E.read(spark, d, "pages").select("page_id", F.regexp_replace("html", "<h([1-6])[^>]*>", "\n# ").alias("t"))
    lines = t.select("page_id", F.length("t").alias("n"), F.posexplode(F.split("t", "\n")).alias("k", "line"))
    before = Window.partitionBy("page_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")).withColumn("h", T.heading(F.col("line"))).filter("h is not null")
    after = Window.partitionBy("page_id").orderBy("k")
    return placed.select("page_id", "start", F.coalesce(F.lead("start").over(after), F.col("n")).alias("end"), F.col("h.label").alias("label"))
