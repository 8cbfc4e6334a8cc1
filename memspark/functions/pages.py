"""Page text, entity decoding and url parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.text import collapse

#: Decoded in this order, the ampersand first.
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "))
MAX_BODY = 12_000
#: Web domains whose label names them as recognised.
RECOGNISED = ("wikipedia.org", "docs.rs", "github.com", "openai.com")


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(html: Column) -> Column:
    """Every tag is a blank; an unclosed one swallows the rest."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "(?s)<[^>]*$", "")


def remove_blocks(html: Column, tag: str) -> Column:
    """Without <tag ...>...</tag>; an unclosed block swallows the rest."""
    return F.regexp_replace(F.regexp_replace(html, f"(?is)<{tag}.*?</{tag}>", ""), f"(?is)<{tag}.*$", "")


def page_text(html: Column, size: int | None = MAX_BODY) -> Column:
    """The text of a page, whole or its first characters."""
    text = collapse(decode_entities(strip_tags(remove_blocks(remove_blocks(html, "script"), "style"))))
    return text if size is None else F.substring(text, 1, size)


def url_domain(url: Column) -> Column:
    host = F.regexp_extract(F.regexp_replace(url, "^.*?://", ""), "^[^/]*", 0)
    host = F.element_at(F.split(host, "@"), -1)
    host = F.lower(F.trim(F.regexp_extract(host, "^[^:]*", 0)))
    return F.when(host != "", host)


def recognised(domain: Column) -> Column:
    ok = F.lit(False)
    for d in RECOGNISED:
        ok = ok | (domain == d) | domain.endswith("." + d)
    return F.coalesce(ok, F.lit(False))
