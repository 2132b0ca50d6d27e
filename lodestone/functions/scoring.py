"""Importance of frames and the summary tier to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3600000.0
#: Weights of age, frequency and recency, and the half-lives in hours that they use.
AGE_WEIGHT, FREQUENCY_WEIGHT, RECENCY_WEIGHT = 0.3, 0.4, 0.3
AGE_HOURS, RECENCY_HOURS = 168.0, 24.0


def importance(now_ms: Column, created_ms: Column, accesses: Column, last_ms: Column) -> Column:
    """0 to 1, from age, access count and the time since the last access; without accesses only age counts."""
    age = F.exp(-F.greatest(F.lit(0.0), (now_ms - created_ms) / HOUR_MS) / AGE_HOURS)
    often = F.least(F.lit(1.0), F.log(accesses + 1) / 5.0)
    since = F.exp(-F.greatest(F.lit(0.0), (now_ms - last_ms) / HOUR_MS) / RECENCY_HOURS)
    whole = AGE_WEIGHT + FREQUENCY_WEIGHT + RECENCY_WEIGHT
    return F.when(accesses.isNull() | (accesses == 0), age).otherwise((AGE_WEIGHT * age + FREQUENCY_WEIGHT * often + RECENCY_WEIGHT * since) / whole)


def tier_by_importance(value: Column, specificity: Column | None = None) -> Column:
    """full, gist or micro; a specific query lifts a frame's importance by up to 0.15."""
    v = value if specificity is None else value + 0.15 * specificity
    return F.when(v >= 0.6, "full").when(v >= 0.3, "gist").otherwise("micro")


def tier_by_age(now_ms: Column, created_ms: Column) -> Column:
    days = (now_ms - created_ms) / (24 * HOUR_MS)
    return F.when(days <= 7, "full").when(days <= 30, "gist").otherwise("micro")
