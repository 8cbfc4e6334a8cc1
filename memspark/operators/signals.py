"""Ranking signals: marks, accesses, source priors and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import timefx as D
from memspark.plans.entities import ACCESS_WEIGHTS, MARK_DELTAS, lookup


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def mark_scores(marks: DataFrame) -> DataFrame:
    """Sum of the deltas of a target's marks that aren't reverted."""
    live = marks if "reverted_at" not in marks.columns else marks.filter("reverted_at is null")
    return live.groupBy("target_id").agg(F.round(F.sum(lookup(F.col("action"), MARK_DELTAS)), 6).alias("mark_score"))


def access_scores(accesses: DataFrame, now: int) -> DataFrame:
    """Newest first, weights add up per target and are clamped to +-0.6 on every update but the first.

    All weights are positive, so the clamped fold is the least of 0.6 and the sum, save for a
    first weight above 0.6, which none is: the sum combines map-side.
    """
    w = D.recency_weight(lookup(F.col("kind"), ACCESS_WEIGHTS), F.col("accessed_at"), now)
    return accesses.filter(D.within_horizon(F.col("accessed_at"), now)).groupBy("target_id").agg(F.round(F.least(F.lit(0.6), F.sum(w)), 6).alias("access_score"), F.count("*").alias("accesses"))


def source_signal(kind: Column, trust: Column, confidence: Column, retrieved: Column, expires: Column, now: int) -> Column:
    """Prior of the source type, trust, confidence and freshness, clamped to +-0.18."""
    prior = F.when(kind == "web_finding", -0.01).when(kind.isin("derived_memory", "brain_artifact"), -0.04).when(kind == "chat", 0.01).otherwise(0.04)
    total = prior + F.coalesce((trust - 0.5) * 0.18, F.lit(0.0)) + F.coalesce((confidence - 0.5) * 0.12, F.lit(0.0)) + D.freshness_signal(retrieved, now) - F.when(D.norm_ms(expires) <= now, 0.12).otherwise(0.0)
    return clamp(total, -0.18, 0.18)


def rescore(base: Column, boost: Column, signal: Column) -> Column:
    return F.greatest(base + clamp(boost, -0.45, 0.55) + signal, F.lit(0.001))


def session_scores(marks: DataFrame, accesses: DataFrame, now: int) -> DataFrame:
    """target_id, session_score: a chat session's attention, its marks and accesses together; only the whole boost of a hit is clamped."""
    own = mark_scores(marks).join(access_scores(accesses, now).select("target_id", "access_score"), "target_id", "full")
    total = F.coalesce("mark_score", F.lit(0.0)) + F.coalesce("access_score", F.lit(0.0))
    return own.select("target_id", F.round(total, 6).alias("session_score"))
