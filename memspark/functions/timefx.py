"""Epoch-millisecond arithmetic: freshness, recency and staleness. `now` is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000


def norm_ms(c: Column) -> Column:
    """Values below 10^10 are seconds."""
    ms = c.cast("long")
    return F.when(ms < 10_000_000_000, ms * 1000).otherwise(ms)


def freshness_status(retrieved: Column, expires: Column, now: int, override: Column | None = None) -> Column:
    age = F.lit(now) - norm_ms(retrieved)
    status = (
        F.when(retrieved.isNull() | F.lit(now == 0), "unknown")
        .when(norm_ms(expires) <= now, "refresh_needed")
        .when(age <= 14 * DAY, "fresh")
        .when(age <= 60 * DAY, "aging")
        .otherwise("stale")
    )
    return status if override is None else F.coalesce(override, status)


def freshness_signal(retrieved: Column, now: int) -> Column:
    age = F.lit(now) - norm_ms(retrieved)
    if now == 0:
        return F.lit(0.0)
    return F.when(retrieved.isNull(), 0.0).when(age <= 7 * DAY, 0.08).when(age <= 30 * DAY, 0.02).when(age <= 180 * DAY, -0.03).otherwise(-0.08)


def recency_weight(weight: Column, at: Column, now: int) -> Column:
    age = F.greatest(F.lit(now) - at, F.lit(0)) / (7 * DAY)
    return weight * F.when(age >= 1, 0.25).otherwise(0.45 + 0.55 * (1 - age))


def default_expiry(retrieved: Column) -> Column:
    return retrieved + 30 * DAY


def within_horizon(at: Column, now: int) -> Column:
    return at >= now - 30 * DAY


def training_stale(retrieved: Column, now: int) -> Column:
    return (retrieved == 0) | (norm_ms(retrieved) + 90 * DAY < now)
