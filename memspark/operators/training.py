"""Training records from chunks, gates and their evaluation, dataset summaries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import hashing as H
from memspark.functions import privacy as S
from memspark.functions import text as T

CHUNK_TASKS = ("query_to_region", "query_to_source_family", "query_to_tool_plan", "chunk_to_semantic_address", "snippet_set_to_citation_boundary", "web_needed_or_not", "weak_evidence_to_next_action")
#: The evaluation sets and the task each looks at.
EVAL_SETS = {"routing": "query_to_region", "citation": "snippet_set_to_citation_boundary", "tools": "query_to_tool_plan", "web": "web_needed_or_not", "family": "query_to_source_family", "address": "chunk_to_semantic_address"}


def record_id(task: Column, split: Column, source: Column, given: Column, target: Column) -> Column:
    return F.concat_ws(":", task, split, F.sha2(F.concat_ws(":", source, given, target), 256))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Seven records per chunk (chunk_id, document_id, region, family, text): one explode, no join.

    Only names of tasks are exploded and the rest follows from them, so what a query leaves out is never made.
    """
    c = {n: F.col(n) for n in ("chunk_id", "region", "family")}
    doc = F.col("document_id").cast("string")
    hint = F.col("hint")  # redacted once a chunk; the words around it hold no secrets
    anchor = F.concat(c["chunk_id"], F.lit(":anchor"))
    pairs = {
        "query_to_region": (F.concat(F.lit("Where should the library search for: "), hint, F.lit("?")), F.concat(F.lit("route_region:"), c["region"])),
        "query_to_source_family": (F.concat(F.lit("Classify the best source family for '"), doc, F.lit("'.")), F.concat(F.lit("source_family:"), c["family"])),
        "query_to_tool_plan": (F.concat(F.lit("Plan tools for: "), hint), F.lit("memory_search;memory_open;memory_expand;cite_anchor")),
        "chunk_to_semantic_address": (F.concat(F.lit("Address of: "), hint), F.concat(F.lit("region:"), c["region"], F.lit(";document:"), doc, F.lit(";source_family:"), c["family"], F.lit(";anchor:"), anchor)),
        "snippet_set_to_citation_boundary": (F.concat(F.lit("Cite: "), hint), F.concat(F.lit("cite_anchor_ids:"), anchor, F.lit(";do_not_cite_without_source_anchor"))),
        "web_needed_or_not": (F.concat(F.lit("Is the web needed for: "), hint), F.lit("web_search_not_needed:source_available")),
        "weak_evidence_to_next_action": (F.concat(F.lit("Evidence is weak for: "), hint), F.lit("weak_evidence:search_original_sources")),
    }
    # What is the same for all records of a chunk is made before there are seven.
    once = chunks.withColumn("hint", S.redact(T.bounded(F.col("text"), 80))).withColumn("split", H.split_name(F.col("chunk_id")))
    rows = once.select("chunk_id", "document_id", "region", "family", "hint", "split", F.explode(F.array(*map(F.lit, pairs))).alias("task"))
    of_task = lambda k: _by_task({t: p[k] for t, p in pairs.items()}, F.col("task"))
    out = rows.select(F.col("chunk_id").alias("source_id"), "family", "task", of_task(0).alias("input"), of_task(1).alias("target"), "split")
    return out.withColumn("id", record_id(F.col("task"), F.col("split"), F.col("source_id"), F.col("input"), F.col("target")))


def _by_task(table: dict[str, Column], task: Column) -> Column:
    """CASE over tasks; null for others."""
    out = None
    for name, c in table.items():
        out = F.when(task == name, c) if out is None else out.when(task == name, c)
    return out


#: Per task the alternatives of parts a target must hold, parts joined by blanks; ^ marks one it must begin with.
GATES = {
    "query_to_region": ["^route_region:"],
    "query_to_source_family": ["^source_family:"],
    "query_to_tool_plan": ["memory_search memory_expand"],
    "chunk_to_semantic_address": ["region: document: anchor:"],
    "snippet_set_to_citation_boundary": ["cite_anchor_ids do_not_cite"],
    "web_needed_or_not": ["web_search_needed", "web_search_not_needed"],
    "weak_evidence_to_next_action": ["weak_evidence", "search_original_sources"],
    "deleted_or_stale_memory_to_caution": ["caution:"],
    "recursive_role_trace": ["roles: planner critic latent_status:research_only"],
    "recursive_sufficiency_eval": ["sufficient:true cite_anchor_ids:", "sufficient:false next_action:"],
    "recursive_efficiency_eval": ["efficiency: tool_calls: source_grounded:"],
    "recursive_region_selection_eval": ["region_source_selection: selected_refs:", "region_source_selection: next_action:"],
    "recursive_hallucination_eval": ["hallucination_risk: source_anchored", "hallucination_risk: caveat_or_refuse"],
    "recursive_token_usage_eval": ["token_usage: baseline_tool_calls: fallback:text_tool"],
}
#: Fixed value: the tasks whose input may not be blank.
ASKING_TASKS = ("query_to_region",)


def passes_gate(task: Column, given: Column, target: Column) -> Column:
    """Does a record's target hold the parts of one alternative of its task? Unknown tasks fail."""
    low = F.lower(target)
    part = lambda p: low.startswith(p[1:]) if p.startswith("^") else low.contains(p)
    way = lambda w: functools.reduce(Column.__and__, map(part, w.split(" ")))
    met = _by_task({name: functools.reduce(Column.__or__, map(way, ways)) for name, ways in GATES.items()}, task)
    return F.coalesce(met & (~task.isin(*ASKING_TASKS) | (F.trim(given) != "")), F.lit(False))


def evaluate(records: DataFrame) -> DataFrame:
    """Per task: records, passed and score."""
    ok = passes_gate(F.col("task"), F.col("input"), F.col("target"))
    return records.groupBy("task").agg(F.count("*").alias("records"), F.count_if(ok).alias("passed")).withColumn("score", F.round(F.col("passed") / F.col("records"), 6))


def route_baseline(records: DataFrame) -> DataFrame:
    """1 / number of distinct route targets, 0 with one or none."""
    n = F.countDistinct(F.when(F.col("task") == "query_to_region", F.col("target")))
    return records.agg(n.alias("targets"), F.round(F.when(n > 1, 1.0 / n).otherwise(0.0), 6).alias("baseline"))


def summary(records: DataFrame) -> DataFrame:
    """Counts by task, split, family and in all, as grouping sets."""
    return records.groupingSets([["task"], ["split"], ["family"], []], "task", "split", "family").agg(F.count("*").alias("records"))
