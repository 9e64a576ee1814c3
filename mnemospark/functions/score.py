"""Scores of memories, accesses and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_distance(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


def from_distance_decay(d: Column) -> Column:
    return F.exp(-d / 10.0)


def from_rank(r: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(r))


def activation(start: Column, age_ms: Column, rehearsals: Column, decay_ms: float = 60_000.0) -> Column:
    return F.least(F.lit(1.0), start * F.exp(-age_ms / decay_ms) + F.least(F.lit(1.0), rehearsals * 0.1))


def importance(accesses: Column, idle_s: Column) -> Column:
    """0.4 recency + 0.6 frequency; recency falls with the days after the first."""
    days = idle_s / 86400.0
    recency = F.when(days < 1, 1.0).otherwise(F.lit(1.0) / (F.lit(1.0) + days))
    return recency * 0.4 + F.least(F.lit(1.0), accesses / 100.0) * 0.6


def regularity(variance: Column, accesses: Column) -> Column:
    return F.when(accesses < 2, 0.5).otherwise(F.exp(-F.coalesce(variance, F.lit(0.0)) / 1e6))


def decay_days(age_s: Column, days: float = 30.0) -> Column:
    return F.exp(-F.floor(age_s / 86400.0) / days)


def capped(n: Column, per: float, cap: float = 1.0) -> Column:
    return F.least(n / per, F.lit(cap))


def boosted(importance_: Column) -> Column:
    return F.least(F.lit(1.0), importance_ * 1.5)


def fused(confidence: Column, timeliness: Column, personal: Column, diversity: Column) -> Column:
    """The weighted sum that ranks recommendations."""
    return confidence * 0.3 + timeliness * 0.2 + personal * 0.3 + diversity * 0.2
