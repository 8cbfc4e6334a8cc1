"""The registered queries opN_<name> over the synthetic tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import ann, fingerprints, langid, licenses, mixing, ngram_join, packing, runs, secrets, toxicity, trie, urlfilter, warc
from memspark.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op5_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op10_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.grafted(trie.numbered(table(spark, sf_dir, "conversations"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find(runs.planted(table(spark, sf_dir, "documents"))))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_warc_index_merge, op2_secret_scan, op3_language_id, op4_source_mixing, op5_canonical_digest, op6_min_bin_slack, op7_learned_partitions, op8_license_scan, op9_url_filter, op10_grouped_prefix_join, op11_prefix_trie, op12_periodic_runs, op13_toxicity)}

_OP1_SQL = f"""
WITH p AS (SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d),
u AS (SELECT *, CASE WHEN url LIKE '%://%' THEN regexp_replace(url, '^.*?://', '') ELSE url END AS rest FROM f)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
  CASE WHEN url IS NULL THEN '' ELSE array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^[^/?#]*')), '.')), ',') || ')' || regexp_replace(rest, '^[^/?#]*', '') END AS url_key,
  epoch(TIMESTAMP '{warc.FIRST_CAPTURE}')::BIGINT + (coalesce(page_id, 0) % {warc.DATED} + {warc.DATED}) % {warc.DATED} AS capture_ts
FROM u"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {ngram_join.DENOM} * shared >= {ngram_join.NUMER} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = doc_id"""

ORACLE_SQL = {"op1_warc_index_merge": _OP1_SQL, "op4_source_mixing": mixing.oracle(), "op10_grouped_prefix_join": _OP10_SQL, "op11_prefix_trie": trie.oracle()}
