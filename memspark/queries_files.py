"""Queries on files, exports and backups, and on functions over the texts and metadata of the tables (S, K, P, F, D, T, W, X rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark import oracle as O
from memspark.functions import privacy as P
from memspark.functions import text as T
from memspark.functions import timefx as D
from memspark.operators import sinks
from memspark.operators import training as G
from memspark.plans import entities as E
from memspark.plans.scratch import shared_path, written
from memspark.queries_training import _RECORDS, records
from memspark.registry import query
from memspark.sources import files as S

NOW = E.NOW_MS
#: Folders below each watched root.
FOLDERS = 64
_LINE = "replace(replace(coalesce({0}, ''), chr(10), ' '), chr(13), ' ')"
_TRIMMED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _one_line(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " ")


@query("w7_section_hierarchy", r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, role, length('## ' || role) + 1 + length('### turn ' || turn) + 1 + length('> ' || replace(replace(text, chr(10), ' '), chr(13), ' ')) + 1 AS size FROM conversations),
s AS (SELECT *, length('# session ' || conv_id) + 1 + coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM t),
h AS (SELECT conv_id, 0 AS start, 'session ' || conv_id AS value, 'session ' || conv_id AS hierarchy FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, spot, role, 'session ' || conv_id || ' > ' || role FROM s UNION ALL SELECT conv_id, spot + length('## ' || role) + 1, 'turn ' || turn, 'session ' || conv_id || ' > ' || role || ' > turn ' || turn FROM s),
n AS (SELECT conv_id, max(spot + size) - 1 AS total FROM s GROUP BY conv_id)
SELECT conv_id, start::INT AS start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start), total)::INT AS "end", value, hierarchy, len(string_split(hierarchy, ' > '))::INT AS depth FROM h JOIN n USING (conv_id)""")
def w7(spark, d):
    """Sections of sessions written as Markdown outlines: where each heading reaches and what it stands under."""
    turn = F.concat(F.lit("## "), "role", F.lit("\n### turn "), "turn", F.lit("\n> "), _one_line(F.col("text")))
    outline = E.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("body")))).alias("turns"))
    text = F.concat(F.lit("# session "), "conv_id", F.lit("\n"), F.array_join("turns.body", "\n"))
    found = outline.select("conv_id", text.alias("text")).select("conv_id", F.explode(T.section_spans(F.col("text"))).alias("s"))
    return found.select("conv_id", "s.start", "s.end", "s.value", "s.hierarchy", F.size(T.split_hierarchy(F.col("s.hierarchy"))).alias("depth"))


@query("s6_parsed_pages", f"""WITH p AS (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {_TRIMMED.format('x')}), lambda x: x <> ''), chr(10)) AS page FROM conversations),
k AS (SELECT * FROM p WHERE page <> '')
SELECT conv_id, md5(left(string_agg(page, chr(10) || chr(10) ORDER BY turn), {T.MAX_DOCUMENT_CHARS})) AS digest, count(*)::INT AS pages, (sum(length(page)) + 2 * (count(*) - 1))::INT AS chars FROM k GROUP BY conv_id""")
def s6(spark, d):
    """Turns of a session as pages split by form feeds: the parsed text and where its pages lie."""
    raw = E.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")).select("conv_id", F.array_join("turns.text", "\f").alias("raw"))
    spans = raw.select("conv_id", S.parse_pages(F.col("raw")).alias("text"), S.page_spans(F.col("raw")).alias("spans"))
    return spans.select("conv_id", F.md5("text").alias("digest"), F.size("spans").alias("pages"), F.element_at("spans", -1)["end"].alias("chars"))


@query("f32_location_hints", f"""WITH {O.CHUNKS} SELECT document_id, ordinal, CASE WHEN start >= 2000 THEN 'page ' || (start // 2000 + 1) || ', ' ELSE '' END || CASE WHEN lang <> 'en' THEN 'section ' || lang || ', ' ELSE '' END || 'chars ' || start || '-' || "end" AS hint FROM chunks JOIN documents ON doc_id = document_id""")
def f32(spark, d):
    """Where a chunk lies in words; a page or section that isn't known is left out."""
    langs = E.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("lang") != "en", F.col("lang")).alias("section"))
    c = E.chunk_spans(spark, d).join(langs, "document_id")
    page = F.when(F.col("start") >= 2000, (F.floor(F.col("start") / 2000) + 1).cast("string"))
    return c.select("document_id", "ordinal", T.location_hint(page, F.col("section"), F.col("start").cast("string"), F.col("end").cast("string")).alias("hint"))


@query("f33_file_uris", "SELECT page_id, url, 'file:///store/' || page_id AS absolute, 'pages/' || page_id AS relative FROM pages")
def f33(spark, d):
    """Urls stay, absolute paths become file uris, relative ones stay."""
    at = lambda prefix: F.concat(F.lit(prefix), "page_id")
    return E.read(spark, d, "pages").select("page_id", T.file_uri(F.col("url")).alias("url"), T.file_uri(at("/store/")).alias("absolute"), T.file_uri(at("pages/")).alias("relative"))


@query("d5_expiries", f"WITH {O.FINDINGS} SELECT page_id, retrieved_at + 30 * {D.DAY}::BIGINT AS expires_at, retrieved_at + 90 * {D.DAY}::BIGINT < {NOW} AS training_stale, retrieved_at >= {NOW} - 30 * {D.DAY}::BIGINT AS within_horizon FROM findings")
def d5(spark, d):
    """When a finding expires, and whether it is too old for training or for the access horizon."""
    at = F.col("retrieved_at")
    return E.findings(spark, d).select("page_id", D.default_expiry(at).alias("expires_at"), D.training_stale(at, NOW).alias("training_stale"), D.within_horizon(at, NOW).alias("within_horizon"))


@query("p3_coalesced_metadata", f"WITH {O.CHUNKS} SELECT document_id, ordinal, CASE WHEN start > 0 THEN lang || '-' || ordinal ELSE lang END AS lang, source, NULL::VARCHAR AS missing FROM chunks JOIN documents ON doc_id = document_id")
def p3(spark, d):
    """Metadata of chunks: what the chunk itself says shadows its document; a document's first chunk says nothing."""
    meta = E.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("whole"), "lang")
    rows = E.chunk_spans(spark, d).join(meta, "document_id")
    own = F.when(F.col("start") > 0, F.create_map(F.lit("lang"), F.concat_ws("-", "lang", "ordinal"))).otherwise(F.create_map().cast("map<string,string>"))
    of = lambda key: P.value(F.col("own"), F.col("whole"), key).alias(key)
    return rows.withColumn("own", own).select("document_id", "ordinal", of("lang"), of("source"), of("missing"))


def _gate_sql(task: str) -> str:
    part = lambda p: f"starts_with(lower(target), '{p[1:]}')" if p.startswith("^") else f"contains(lower(target), '{p}')"
    return "(" + " OR ".join("(" + " AND ".join(part(p) for p in way.split(" ")) + ")" for way in G.GATES[task]) + ")"


_ANY_GATE = " UNION ALL ".join(f"SELECT task, '{name}' AS gate, count(*) FILTER ({_gate_sql(name)}) AS passed, count(*) AS records FROM records GROUP BY task" for name in G.GATES)


@query("t4_gates_of_tasks", f"WITH {_RECORDS} {_ANY_GATE}")
def t4(spark, d):
    """How many records of each task pass the gate of every task: their own, and those whose parts they happen to hold."""
    gates = F.explode(F.array(*map(F.lit, G.GATES)))
    rows = records(spark, d).select("task", "target", gates.alias("gate"))
    asked = F.lit("asked")  # records always ask something; the blank ones are in the tests
    return rows.groupBy("task", "gate").agg(F.count_if(G.passes_gate(F.col("gate"), asked, F.col("target"))).alias("passed"), F.count("*").alias("records"))


@query("k4_exported_records", f"WITH {_RECORDS} SELECT chunk_id AS source_id, task, target FROM records WHERE split = 'eval'")
def k4(spark, d):
    """Records exported as JSON lines by task and split, and one split read back."""
    out = shared_path(spark, "export")
    sinks.export_records(records(spark, d).select("source_id", "task", "split", "target"), f"{out}/records")
    return S.read_records(spark, f"{out}/records", "eval", "source_id string, target string, task string, split string").select("source_id", "task", "target")


@query("k5_prompt_files", f"""WITH {_RECORDS}, chosen AS (SELECT split FROM (SELECT DISTINCT split FROM records) ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'eval' THEN 1 ELSE 2 END LIMIT 1)
SELECT 'Where should the library search for: ' || hint || '?' AS prompt, target AS completion, count(*) AS copies FROM records JOIN hinted USING (chunk_id) JOIN chosen USING (split) WHERE task = 'query_to_region' GROUP BY ALL""")
def k5(spark, d):
    """Prompts and completions of a split written as JSON lines and read back."""
    out = shared_path(spark, "prompts")
    rows = written(records(spark, d).filter("task = 'query_to_region'").select("split", "input", "target"), "prompt-records")
    sinks.prompts(rows, "test").write.json(f"{out}/rows")
    return spark.read.schema("prompt string, completion string").json(f"{out}/rows").groupBy("prompt", "completion").agg(F.count("*").alias("copies"))


@query("k6_restored_backup", "SELECT page_id, '/new/place/' || page_id || '.html' AS path, sha256(html) AS file_hash FROM pages")
def k6(spark, d):
    """A backup restored after later changes, its paths moved to another folder."""
    root = shared_path(spark, "backup")
    artifacts = E.read(spark, d, "pages").select("page_id", F.concat(F.lit("/old/lib/"), "page_id", F.lit(".html")).alias("path"), F.sha2("html", 256).alias("file_hash"))
    sinks.save_version(spark, {"artifacts": artifacts}, root, "first")
    sinks.save_version(spark, {"artifacts": artifacts.filter("page_id < 0")}, root, "later")
    assert sinks.load_version(spark, root, "artifacts").isEmpty()
    return sinks.rebase_paths(sinks.load_version(spark, root, "artifacts", "first"), ["path"], "/old/lib", "/new/place")


@query("s8_json_store", "SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, max(text) AS last FROM documents GROUP BY source, lang")
def s8(spark, d):
    """Documents stored as JSON files, one for each source and language, and read as one store."""
    root = shared_path(spark, "json-store")
    docs = E.read(spark, d, "documents")
    body = docs.groupBy("source", "lang", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.collect_list(F.struct("doc_id", "n_chars", "text")).alias("documents"))
    # A file holds one JSON object: each row is a file of its own in one folder.
    body.select(F.to_json(F.struct("source", "lang", "documents")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{root}/store")
    schema = "source string, lang string, documents array<struct<doc_id:long,n_chars:long,text:string>>"
    rows = S.read_json_store(spark, f"{root}/store", schema).select("source", "lang", F.explode("documents").alias("x"))
    return rows.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("x.n_chars").alias("chars"), F.max("x.text").alias("last"))


_FILE = "sha256(" + _LINE.format("text") + " || chr(10))"


@query("s11_watched_files", f"""WITH f AS (SELECT conv_id, turn, {_FILE} AS h FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN NULL ELSE h END AS file_hash, conv_id % 4 <> 3 AS available FROM f""")
def s11(spark, d):
    """Hashes of files below watched folders: those of a folder that isn't enabled are not available."""
    root = shared_path(spark, "watched")
    turns = E.read(spark, d, "conversations").select("conv_id", "turn", _one_line(F.col("text")).alias("value"), F.pmod("conv_id", F.lit(4)).alias("root"))
    name = F.concat_ws("-", "conv_id", "turn", F.xxhash64("conv_id", "turn", "value"))  # turns that share a number but not a text are files of their own
    # Folders are a fixed number for each root, whatever the number of files.
    folder = F.concat(F.lit("root="), "root", F.lit("/"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(FOLDERS)))
    sinks.write_files(turns.repartition("conv_id", "turn").select(folder.alias("folder"), F.concat(name, F.lit(".txt")).alias("name"), F.encode(F.concat("value", F.lit("\n")), "utf-8").alias("content")), f"{root}/files")
    roots = spark.range(4).select(F.concat(F.lit(f"{root}/files/root="), "id").alias("path"), (F.col("id") != 3).alias("enabled"))
    seen = S.watch_hashes(spark, roots).select(F.regexp_extract("path", r"/([^/]+)\.txt$", 1).alias("name"), "file_hash")
    known = turns.select("conv_id", "turn", name.alias("name")).join(seen, "name", "left")
    return known.select("conv_id", "turn", "file_hash", F.col("file_hash").isNotNull().alias("available"))


@query("k9_managed_copies", """SELECT sha256(text) AS file_hash, left(sha256(text), 2) AS shard, count(*) AS files, strlen(any_value(text))::BIGINT AS stored_bytes FROM documents GROUP BY 1, 2""")
def k9(spark, d):
    """Files stored once by content: how many files share each copy, and what lies in the store."""
    root = shared_path(spark, "managed")
    rows = E.read(spark, d, "documents").select(F.concat(F.lit("/in/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    files = S.managed_copy(rows, f"{root}/store").groupBy("file_hash").agg(F.count("*").alias("files"))
    store = spark.read.parquet(f"{root}/store").select("file_hash", F.regexp_extract(F.col("_metadata.file_path"), "shard=([^/]+)/", 1).alias("shard"), F.length("content").cast("long").alias("stored_bytes"))
    return files.join(store, "file_hash").select("file_hash", "shard", "files", "stored_bytes")


@query("x21_document_hashes", "SELECT doc_id, CASE WHEN quality = 1 THEN md5(text) ELSE sha256(text) END AS hash FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def x21(spark, d):
    """The file hash of documents that have one (here the good ones; others have blanks or none), else that of their content."""
    good = E.read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = E.read(spark, d, "documents").join(good, "doc_id", "left")
    own = F.when(F.col("quality") == 1, F.md5("text")).when(F.col("quality") == 0, F.lit("  "))
    return rows.select("doc_id", S.document_hash(own, F.sha2("text", 256)).alias("hash"))
