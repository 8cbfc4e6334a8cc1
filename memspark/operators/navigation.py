"""Navigation: passages, links of a node, expansion, trust policies. Session replay: see sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default trust by kind of source.
TRUST = {
    "local_source": 0.86, "user_authored_note": 0.90, "imported_document": 0.82, "web_finding": 0.58,
    "generated_summary": 0.35, "compiler_artifact": 0.25, "chat_transcript": 0.70, "unknown": 0.50,
}
#: Kinds that a source type falls back to.
TRUST_KIND = {"web_finding": "web_finding", "derived_memory": "generated_summary", "brain_artifact": "compiler_artifact", "chat": "chat_transcript", "local_file": "imported_document"}


def trust(source_type: Column, override: Column | None = None) -> Column:
    """Struct (kind, score) with the default of the type, or the given score."""
    from memspark.plans.entities import lookup

    kind = F.coalesce(lookup(source_type, TRUST_KIND), F.lit("unknown"))
    score = lookup(kind, TRUST).cast("double")
    return F.struct(kind.alias("kind"), (score if override is None else F.coalesce(override, score)).alias("score"))


def first_passages(chunks: DataFrame, k: int = 5) -> DataFrame:
    """A document's first k chunks; ordinals count from 0 without gaps, so no ranking is needed."""
    return chunks.filter(F.col("ordinal") < k)


def both_ways(links: DataFrame) -> DataFrame:
    """Every link seen from both ends: node, other, link columns."""
    rest = [c for c in links.columns if c not in ("source", "target")]
    return links.select(F.col("source").alias("node"), F.col("target").alias("other"), *rest).unionByName(links.select(F.col("target").alias("node"), F.col("source").alias("other"), *rest)).dropDuplicates(["node", "other"])


def bounding_boxes(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """min(start) and max(end) of the chunks that share the keys."""
    return chunks.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
