"""Queries on files, tables in texts, JSON bodies, the stream of revisions and the snapshot of the graph (S, F, AJ, K, G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import tables as MT
from memspark.functions import text as T
from memspark.functions import vector as V
from memspark.functions.json_text import rebase_json
from memspark.operators import graph as L
from memspark.operators import knowledge as K
from memspark.operators import similarity as Y
from memspark.operators import sinks
from memspark.plans import entities as E
from memspark.plans.scratch import shared_path, written
from memspark.queries_links import _DOCUMENT_LINKS, _EMBEDDED, document_links
from memspark.queries_more import _BASIS
from memspark.registry import query
from memspark.sources import files as S
from memspark.streaming import accesses, revisions

_REVISED = f"WITH {O.FINDINGS} SELECT page_id, domain, prev AS previous_hash, content_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY domain ORDER BY retrieved_at, page_id) AS prev FROM findings) WHERE prev IS NOT NULL AND prev <> content_hash"


@query("k3_revision_stream", _REVISED)
def k3_stream(spark, d):
    """Captures as a stream that is read to its end: a row for each that differs from the one before it of its domain."""
    captures = E.captured(accesses.read_events(spark, f"{d}/pages.parquet")).select("page_id", "domain", "content_hash", "retrieved_at")
    out = shared_path(spark, "revisions")
    accesses.run_once(revisions.revisions(captures), f"{out}/rows", f"{out}/state")
    return spark.read.schema(revisions.SCHEMA).parquet(f"{out}/rows")


_LISTED = "SELECT c_custkey // 100 AS doc, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS k, c_name || ' | ' || c_nationkey AS name, c_mktsegment AS department, 'say \"' || n_name || '\", ok' AS position FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _customer_documents(spark, d):
    """A document for every hundred customers: lines of comma-separated values with bars, quotes and commas in them."""
    c = E.read(spark, d, "customer").join(E.read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    position = F.concat(F.lit('say "'), "n_name", F.lit('", ok'))
    line = F.concat_ws(",", F.concat_ws(" | ", "c_name", "c_nationkey"), "c_mktsegment", quoted(position))
    lines = c.select(F.floor(F.col("c_custkey") / 100).alias("doc"), "c_custkey", line.alias("line")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("lines"))
    return lines.select("doc", F.concat(F.lit("Contact,Department,Job_Title\n"), F.array_join("lines.line", "\n")).alias("text"))


@query("f27_table_answers", f"""SELECT doc, 'Found ' || count(*) || ' row(s) in `contacts-' || doc || '`.' || chr(10) || chr(10) || 'Source: `/store/' || doc || '.csv`' || chr(10) || chr(10) || '| Name | Email | Department | Position |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
|| string_agg('| ' || replace(name, '|', '\\|') || ' |  | ' || department || ' | ' || position || ' |', chr(10) ORDER BY k) || chr(10) AS answer FROM ({_LISTED}) GROUP BY doc""")
def f27_answers(spark, d):
    """Listings of the customers' documents as Markdown tables: columns found by their headers, bars escaped."""
    title, path = F.concat(F.lit("contacts-"), "doc"), F.concat(F.lit("/store/"), "doc", F.lit(".csv"))
    parsed = _customer_documents(spark, d).select("doc", T.parse_table(F.col("text")).alias("t"))
    return parsed.filter("t is not null").select("doc", MT.table_answer(title, path, F.col("t")).alias("answer"))


@query("f27_markdown_rows", f"SELECT doc, k, name, '' AS email, department, position FROM ({_LISTED})")
def f27_rows(spark, d):
    """The Markdown tables of those answers, read back."""
    found = f27_answers(spark, d).select("doc", F.explode(MT.markdown_tables(F.col("answer"))).alias("t"))
    rows = found.select("doc", F.posexplode("t.rows").alias("k", "r"))
    return rows.select("doc", (F.col("k") + 1).cast("long").alias("k"), *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(("name", "email", "department", "position"))])


_BODY = """'{"/old/store":{"k":["/%s/store/' || user_id || '","x /old/store",' || event_id || ',{"p":"/%s/store","q":null}]},"t":"/old/stored","u":[[{"v":"/%s/store/' || event_type || '"}]]}'"""


@query("aj7_rebased_json", f"SELECT event_id, {_BODY % (('new',) * 3)} AS body FROM events")
def aj7_json(spark, d):
    """Strings in nested objects and lists that lie in the old folder move to the new one; keys and likenesses stay."""
    body = F.concat(F.lit('{"/old/store":{"k":["/old/store/'), "user_id", F.lit('","x /old/store",'), "event_id", F.lit(',{"p":"/old/store","q":null}]},"t":"/old/stored","u":[[{"v":"/old/store/'), "event_type", F.lit('"}]]}'))
    return E.read(spark, d, "events").select("event_id", rebase_json(body, "/old/store", "/new/store").alias("body"))


@query("s1_taken_in_files", """SELECT source, lang, count(*) AS files, count(*) FILTER (reason IS NULL) AS imported, count(*) FILTER (reason = 'text too large') AS too_large, count(*) FILTER (reason = 'binary') AS "binary", count(*) FILTER (reason = 'empty') AS empty, coalesce(sum(size) FILTER (reason IS NULL), 0)::BIGINT AS bytes
FROM (SELECT source, lang, sum(strlen(t) + 1) AS size, CASE WHEN sum(strlen(t) + 1) > 2000000 THEN 'text too large' WHEN bool_or(contains(t, chr(0))) THEN 'binary' WHEN bool_and(trim(t, ' ' || chr(9)) = '') THEN 'empty' END AS reason
 FROM (SELECT source, lang, doc_id // 8 AS part, CASE WHEN doc_id % 8 = 7 AND lang = 'fr' THEN chr(0) || 'x' ELSE replace(replace(text, chr(10), ' '), chr(13), ' ') END AS t FROM documents) GROUP BY source, lang, part) GROUP BY source, lang""")
def s1_files(spark, d):
    """Texts of documents as files (a folder for each source and language, a file for eight ids), taken in again: files by fate and the bytes that came through.

    Some French lines carry a NUL, so their files are binary; hidden folders beside them are passed over.
    """
    root = shared_path(spark, "intake")
    docs = E.read(spark, d, "documents")
    line = F.when((F.col("doc_id") % 8 == 7) & (F.col("lang") == "fr"), F.lit("\x00x")).otherwise(F.regexp_replace("text", "[\r\n]", " "))
    lines = docs.groupBy("source", "lang", F.floor(F.col("doc_id") / 8).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("lines"))
    # A row is a file's text, and tasks write each as a file of its own: folders are as many as sources and languages, a null one has no name.
    named = lambda name: F.concat(F.lit(f"{name}"), F.coalesce(F.concat(F.lit("="), F.url_encode(name)), F.lit("")))
    folder = F.concat(named("source"), F.lit("/"), named("lang"))
    folders = F.when(F.col("part") == 0, F.array(folder, F.lit(".trash"))).otherwise(F.array(folder))
    name = F.concat(F.lit("part-"), F.coalesce(F.col("part").cast("string"), F.lit("")), F.lit("-"), F.md5(folder), F.lit(".txt"))
    content = F.concat(F.array_join("lines.line", "\n", ""), F.lit("\n")).cast("binary")
    sinks.write_files(lines.select(F.explode(folders).alias("folder"), name.alias("name"), content.alias("content")), f"{root}/files")
    taken = S.classify(S.walk(spark, f"{root}/files"))
    part = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1))
    of = lambda name: F.when(F.contains("path", F.lit(f"/{name}=")), part(name)).alias(name)
    per = taken.groupBy(of("source"), of("lang"))
    n = lambda c: F.count_if(c)
    reason = F.col("skip_reason")
    return per.agg(F.count("*").alias("files"), n(reason.isNull()).alias("imported"), n(reason == "text too large").alias("too_large"), n(reason == "binary").alias("binary"), n(reason == "empty").alias("empty"), F.coalesce(F.sum(F.when(reason.isNull(), F.col("length"))), F.lit(0)).alias("bytes"))


#: Fixed values of the snapshot: height of documents above their chunks, place of one without chunks, least weight of a link, weight of a chunk's edge to its document, similarity and partners of visual edges.
LIFT, NOWHERE, LEAST_WEIGHT, SOURCE_WEIGHT, VISUAL, PARTNERS = 2.2, (0.0, 4.0, 0.0), 0.45, 0.24, 0.35, 2
_AXES_OF = ", ".join(f"list_inner_product(v, {list(map(float, b))!r}::DOUBLE[]) AS {n}" for n, b in zip("xyz", _BASIS, strict=True))
_PLACES = f"""held AS (SELECT document_id, ordinal, family, coalesce(v, [0::DOUBLE for i in range(64)]) AS v FROM chunks LEFT JOIN emb USING (document_id, ordinal)), raw AS (SELECT document_id, ordinal, family, {_AXES_OF} FROM held),
mid AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM raw), off_ AS (SELECT document_id, ordinal, family, x - cx AS x, y - cy AS y, z - cz AS z FROM raw, mid), far AS (SELECT greatest(0.001, max(sqrt(x * x + y * y + z * z))) AS radius FROM off_),
pos AS (SELECT document_id, ordinal, family, round(x * 18 / radius, 3) AS x, round(y * 18 / radius, 3) AS y, round(z * 18 / radius, 3) AS z FROM off_, far)"""


@query("g12_snapshot_nodes", f"""WITH {_EMBEDDED}, {_PLACES}
SELECT 'chunk:' || document_id || ':' || ordinal AS id, 0.6::DOUBLE AS score, x, y, z, 1::BIGINT AS chunks FROM pos
UNION ALL SELECT 'region:' || family, 1.0, round(avg(x) + 1e-7, 3), round(avg(y) + 1e-7, 3), round(avg(z) + 1e-7, 3), count(*) FROM pos GROUP BY family
UNION ALL SELECT 'document:' || doc_id, 0.9, round(coalesce(avg(x), {NOWHERE[0]}) + 1e-7, 3), round(coalesce(avg(y) + {LIFT}, {NOWHERE[1]}) + 1e-7, 3), round(coalesce(avg(z), {NOWHERE[2]}) + 1e-7, 3), count(document_id) FROM documents LEFT JOIN pos ON document_id = doc_id GROUP BY doc_id""")
def g12_nodes(spark, d):
    """Chunks at their projected places, regions at the mean of their chunks', documents above it."""
    rows = written(E.chunks(spark, d).select("document_id", "ordinal", "family", V.projected(F.col("text"), K.projection_basis(V.DIM)).alias("p")), "snapshot")
    raw = rows.select(F.struct("document_id", "ordinal", "family").alias("vec_id"), *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate("xyz")])
    at = written(K.centred(raw).select("vec_id.*", "x", "y", "z"), "positions")
    mean = lambda c: F.avg(c)
    place = lambda x, y, z: [F.round(c + 1e-7, 3).alias(n) for n, c in zip("xyz", (x, y, z), strict=True)]
    chunks = at.select(F.concat_ws(":", F.lit("chunk"), "document_id", "ordinal").alias("id"), F.lit(0.6).alias("score"), "x", "y", "z", F.lit(1).cast("long").alias("chunks"))
    regions = at.groupBy("family").agg(*place(mean("x"), mean("y"), mean("z")), F.count("*").alias("chunks")).select(F.concat_ws(":", F.lit("region"), "family"), F.lit(1.0), "x", "y", "z", "chunks")
    own = at.groupBy("document_id").agg(mean("x").alias("x"), (mean("y") + LIFT).alias("y"), mean("z").alias("z"), F.count("*").alias("chunks"))
    docs = E.read(spark, d, "documents").select(F.col("doc_id").alias("document_id")).join(own, "document_id", "left")
    docs = docs.select(F.concat_ws(":", F.lit("document"), "document_id"), F.lit(0.9), *place(*[F.coalesce(c, F.lit(n)) for c, n in zip("xyz", NOWHERE, strict=True)]), F.coalesce("chunks", F.lit(0)))
    return chunks.union(regions).union(docs)


@query("g12_snapshot_edges", f"""WITH {_EMBEDDED}, {_DOCUMENT_LINKS}, {O.MARKS}, down AS (SELECT target_id FROM marks GROUP BY target_id HAVING bool_or(action = 'suppress') AND NOT bool_or(action IN ('pin', 'promote', 'hot'))),
ev AS (SELECT document_id * {T.MAX_CHUNKS} + ordinal AS id, v FROM emb),
vp AS (SELECT x.id AS a, y.id AS b, round({O.dot('x.v', 'y.v')} + {Y.NUDGE}, 6) AS score FROM ev x JOIN ev y ON x.id <> y.id WHERE {O.dot('x.v', 'y.v')} > {VISUAL}),
vl AS (SELECT a, l.b AS b, -l.s AS score FROM (SELECT a, unnest(min({{'s': -score, 'b': b}}, {PARTNERS})) AS l FROM vp GROUP BY a))
SELECT 'semantic proximity' AS label, least(a, b) AS a, greatest(a, b) AS b, max(score) AS weight FROM vl GROUP BY 2, 3
UNION ALL SELECT kind, a, b, greatest(score, {LEAST_WEIGHT}) FROM dl WHERE a NOT IN (FROM down) AND b NOT IN (FROM down)
UNION ALL SELECT 'source text', document_id * {T.MAX_CHUNKS} + ordinal, document_id, {SOURCE_WEIGHT} FROM chunks""")
def g12_edges(spark, d):
    """Visual neighbours of chunks, document links whose ends aren't suppressed, and each chunk's edge to its document."""
    chunks = written(E.embedded_chunks(spark, d).drop("text"), "snapshot")
    key = (F.col("document_id") * T.MAX_CHUNKS + F.col("ordinal")).alias("id")
    near = L.canonical_pairs(Y.semantic_links(chunks.select(key, F.col("embedding").alias("v")), VISUAL, PARTNERS)).filter(F.col("score") > VISUAL)
    down = written(L.suppressed(E.marks(spark, d)), "suppressed")
    kept = lambda df, c: df.join(down, F.col(c) == F.col("target_id"), "left_anti")
    links = kept(kept(document_links(spark, d, chunks), "a"), "b")
    edges = near.select(F.lit("semantic proximity").alias("label"), "a", "b", F.col("score").alias("weight"))
    edges = edges.union(links.select("kind", "a", "b", F.greatest("score", F.lit(LEAST_WEIGHT))))
    return edges.union(chunks.select(F.lit("source text"), key, "document_id", F.lit(SOURCE_WEIGHT)))
