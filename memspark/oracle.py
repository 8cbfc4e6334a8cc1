"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from memspark.functions.text import CHUNK_CHARS, CHUNK_STRIDE, MAX_CHUNKS, MAX_DOCUMENT_CHARS, STOP_WORDS
from memspark.plans.entities import ACCESS_WEIGHTS, EVENT_KINDS, MARK_DELTAS, NOW_MS

SPLIT = r"'[^\p{L}\p{M}\p{N}]+'"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), {SPLIT}), lambda w: strlen(w) > 2)"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def case(x: str, table: dict) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {x} = {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + " END"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


STOP = in_list(STOP_WORDS)
CHUNKS = f"""chunks AS (SELECT document_id, family, o::INT AS ordinal, (o * {CHUNK_STRIDE})::INT AS start, least(length(t), o * {CHUNK_STRIDE} + {CHUNK_CHARS})::INT AS "end", substring(t, (o * {CHUNK_STRIDE} + 1)::INT, {CHUNK_CHARS}) AS text
  FROM (SELECT doc_id AS document_id, source AS family, left(text, {MAX_DOCUMENT_CHARS}) AS t, unnest(range(0, least({MAX_CHUNKS}, 1 + greatest(0, ceil((length(left(text, {MAX_DOCUMENT_CHARS})) - {CHUNK_CHARS}) / {float(CHUNK_STRIDE)})))::BIGINT)) AS o FROM documents WHERE length(text) > 0))"""

#: The same of whole texts, however long.
WHOLE_CHUNKS = f"""chunks AS (SELECT document_id, family, o::INT AS ordinal, (o * {CHUNK_STRIDE})::INT AS start, least(length(t), o * {CHUNK_STRIDE} + {CHUNK_CHARS})::INT AS "end", substring(t, (o * {CHUNK_STRIDE} + 1)::INT, {CHUNK_CHARS}) AS text
  FROM (SELECT doc_id AS document_id, source AS family, text AS t, unnest(range(0, 1 + greatest(0, ceil((length(text) - {CHUNK_CHARS}) / {float(CHUNK_STRIDE)}))::BIGINT)) AS o FROM documents WHERE length(text) > 0))"""

_SLOT = "list_reduce(list_prepend(37, [('0x' || substr(hex(tok), 2 * i + 1, 2))::INT for i in range(strlen(tok))]), lambda h, b: (xor(h, b & 63) * 51) & 63)"


def embeddings(source: str, key: str, name: str = "emb") -> str:
    """CTEs that give `name`(key..., v DOUBLE[64]), the hash embedding of source.text."""
    return f"""{name}_tok AS (SELECT {key}, unnest({tokens('text')}) AS tok FROM {source}),
{name}_vocab AS (SELECT tok, {_SLOT} AS slot FROM (SELECT DISTINCT tok FROM {name}_tok)),
{name}_cnt AS (SELECT {key}, slot, count(*)::DOUBLE AS n FROM {name}_tok JOIN {name}_vocab USING (tok) GROUP BY {key}, slot),
{name}_map AS (SELECT {key}, map_from_entries(list((slot, n))) AS m, sqrt(sum(n * n)) AS len FROM {name}_cnt GROUP BY {key}),
{name} AS (SELECT {key}, [coalesce(m[i::INT], 0) / len for i in range(64)] AS v FROM {name}_map)"""


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


ACCESSES = f"""accesses AS (SELECT event_id, user_id AS target_id, {case('event_type', EVENT_KINDS)} AS kind, epoch_us(ts) // 1000 AS accessed_at FROM events WHERE event_type IN {in_list(EVENT_KINDS)})"""
ACCESS_WEIGHT = case("kind", ACCESS_WEIGHTS)
MARKS = "marks AS (SELECT doc_id AS target_id, CASE WHEN toxic = 1 THEN 'suppress' WHEN quality = 1 THEN 'promote' ELSE 'cold' END AS action FROM labels)"
MARK_DELTA = case("action", MARK_DELTAS)
WHOLE_PAGE_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', '', 'gis'), '<script.*$', '', 'gis'), '<style.*?</style>', '', 'gis'), '<style.*$', '', 'gis'), '<[^>]*>', ' ', 'g'), '<[^>]*$', '', 'gs'),
  '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\s+', ' ', 'g'))"""
PAGE_TEXT = f"left({WHOLE_PAGE_TEXT}, 12000)"
DOMAIN = r"lower(trim(regexp_extract(list_last(string_split(regexp_extract(regexp_replace(url, '^.*?://', ''), '^[^/]*'), '@')), '^[^:]*')))"
FINDINGS = f"""findings AS (SELECT page_id, url, {DOMAIN} AS domain, left(whole, 12000) AS body, sha256(whole) AS content_hash, {NOW_MS} - page_id * 3600000 AS retrieved_at FROM (SELECT page_id, url, {WHOLE_PAGE_TEXT} AS whole FROM pages))"""
