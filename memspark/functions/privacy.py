"""Metadata predicates, secret words and privacy classes."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.text import let, words


def value(chunk_meta: Column, doc_meta: Column, key: str) -> Column:
    """The chunk's value shadows the document's."""
    return F.coalesce(F.try_element_at(chunk_meta, F.lit(key)), F.try_element_at(doc_meta, F.lit(key)))


def matches_filters(meta: Column, filters: dict[str, str]) -> Column:
    """All pairs must be present; a missing key fails."""
    ok = F.lit(True)
    for k, v in sorted(filters.items()):
        ok = ok & F.coalesce(F.try_element_at(meta, F.lit(k)) == v, F.lit(False))
    return ok


def deleted(chunk_meta: Column, doc_meta: Column) -> Column:
    return value(chunk_meta, doc_meta, "deleted_at").isNotNull() | value(chunk_meta, doc_meta, "source_deleted_at").isNotNull() | F.coalesce(value(chunk_meta, doc_meta, "deletion_state") == "deleted", F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


#: What a secret word begins with, and what others hold in either case.
SECRET_START, SECRET_PARTS = "sk-", ("api_key", "apikey", "password=", "secret=", "token=")


def secret_word(word: Column) -> Column:
    t = F.regexp_replace(word, "^[\"'`,;:)\\]}]+|[\"'`,;:)\\]}]+$", "")
    return t.startswith(SECRET_START) | _holds_part(t)


def _holds_part(c: Column) -> Column:
    return let(F.lower(c), lambda low: functools.reduce(Column.__or__, [low.contains(p) for p in SECRET_PARTS]))


def _plain(text: Column) -> Column:
    """No word of such a text can be secret: words are only looked at in others, which are few."""
    return ~(text.contains(SECRET_START) | _holds_part(text))


def has_secret(text: Column) -> Column:
    return F.when(_plain(text), F.lit(False)).otherwise(F.exists(words(text), secret_word))


def redact(text: Column) -> Column:
    return F.array_join(F.when(_plain(text), words(text)).otherwise(F.transform(words(text), lambda w: F.when(secret_word(w), F.lit("[REDACTED]")).otherwise(w))), " ")


def privacy_level(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return (
        F.when(v.isin("shared", "project", "shared_project", "shared_project_memory"), "shared_project_memory")
        .when(v.isin("global", "reference", "global_reference", "global_reference_memory"), "global_reference_memory")
        .when(v.isin("excluded", "excluded_from_adapter_training", "training_excluded"), "excluded_from_adapter_training")
        .otherwise("private_user_memory")
    )


def table_listing_request(tokens: Column) -> Column:
    asks = F.arrays_overlap(tokens, F.array(*map(F.lit, ("list", "show", "display", "all", "who"))))
    about = F.arrays_overlap(tokens, F.array(*map(F.lit, ("employee", "employees", "people", "contacts", "users", "customers", "accounts", "rows", "records"))))
    return asks & about


def node_ref(c: Column) -> Column:
    """Struct (kind, id) of chunk:, document: or region: references, else null."""
    kind = F.regexp_extract(c, "^(chunk|document|region):(.+)$", 1)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.regexp_extract(c, "^(chunk|document|region):(.+)$", 2).alias("id")))
