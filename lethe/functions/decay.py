"""Value, decay and forgetting decisions as Columns. ``now`` is always an argument."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lethe.model import DAY, NEVER, Decay

SIGMOID_STEEPNESS = 5.0
HORIZON_UNITS = 1e6


def decay_timestamp() -> Column:
    """The later of writing and last recall."""
    return F.greatest("timestamp", "time_recalled")


def link_term(weight: float, total: Column) -> Column:
    return F.when(total > 0, F.lit(weight) * F.log1p(total.cast("double"))).otherwise(F.lit(0.0))


def memory_significance(d: Decay, default_event: Column | int | None = None) -> Column:
    """Event and own significance, damped links of both, and recalls; all in DOUBLE, so nothing overflows."""
    default = F.lit(d.default_event_significance) if default_event is None else default_event if isinstance(default_event, Column) else F.lit(default_event)
    event = F.coalesce("event_significance", F.lit(0))
    return (
        F.when(event == 0, default).otherwise(event).cast("double")
        + F.col("significance").cast("double")
        + link_term(d.link_weight, F.coalesce("event_link_significance", F.lit(0)))
        + link_term(d.link_weight, F.col("link_significance"))
        + F.lit(d.recall_weight) * F.col("recall_count")
    )


def event_significance(d: Decay) -> Column:
    return F.col("significance").cast("double") + link_term(d.link_weight, F.col("link_significance"))


def value(s: Column, age: Column, d: Decay) -> Column:
    """The value of significance s at an age in units, under one of six curves; no other method forgets."""
    a = d.aggressiveness
    never = F.lit(NEVER)
    if d.method == 1:
        return s / F.pow(age, F.lit(a))
    if d.method == 2:
        return s / (age * F.lit(math.exp(a)))
    if d.method == 3:
        factor = 1 + math.log(a) if a > 0 else -math.inf
        return s / (age * F.lit(factor)) if factor > 0 else never
    if d.method == 4:
        return s / F.exp(age * F.lit(a))
    if d.method == 5:
        factor = F.lit(a) * F.ln(age + F.lit(math.e))
        return F.when(factor > 0, s / factor).otherwise(never)
    if d.method == 6:
        if a == 0:
            return F.when(age > 0, F.lit(0.0)).otherwise(s)
        return s / (1 + F.exp(F.lit(SIGMOID_STEEPNESS) * (age / F.lit(a) - 1)))
    return never


def age_units(since: Column, now: int, d: Decay) -> Column:
    return (F.lit(now) - since).cast("double") / F.lit(float(DAY)) / F.lit(d.unit_days)


def whole_days(since: Column, now: int) -> Column:
    """Truncated days, as an integer division."""
    gap = F.lit(now) - since
    return (gap - gap % F.lit(DAY)) / F.lit(DAY)


def memory_value(s: Column, since: Column, now: int, d: Decay) -> Column:
    age = age_units(since, now, d)
    return F.when(age <= 0, F.lit(NEVER)).otherwise(value(s, age, d))


def retained(since: Column, now: int, d: Decay) -> Column:
    return whole_days(since, now) < d.retention_days if d.retention_days > 0 else F.lit(False)


def threshold(d: Decay, pressure: float = 1.0) -> float:
    return d.threshold * (pressure if pressure > 0 else 1.0)


def forgettable(s: Column, since: Column, now: int, d: Decay, pressure: float = 1.0) -> Column:
    age = age_units(since, now, d)
    due = F.when(age > 0, value(s, age, d) < F.lit(threshold(d, pressure))).otherwise(F.lit(False))
    return ~retained(since, now, d) & (whole_days(since, now) >= d.minimum_age_days) & due


def pressure(memories: int, used_bytes: int, d: Decay) -> float:
    """1 + utilisation ** exponent, of the fuller of both capacities."""
    use = memories / d.capacity_memories if d.capacity_memories > 0 else 0.0
    if d.capacity_bytes > 0:
        use = max(use, used_bytes / d.capacity_bytes)
    return 1.0 if use == 0 else 1 + use**d.pressure_exponent


def eviction_floor(d: Decay) -> int:
    return d.capacity_floor if 0 < d.capacity_floor <= d.capacity_bytes else d.capacity_bytes


def crossing_units(s: Column, limit: float, d: Decay) -> Column:
    """The age at which the value falls below the limit: 0 if it starts below, -1 if not within the horizon."""
    if limit <= 0:
        return F.lit(-1.0)
    a, ratio = d.aggressiveness, s / F.lit(limit)
    at_horizon = value(s, F.lit(HORIZON_UNITS), d)
    if d.method == 1:
        age = F.pow(ratio, F.lit(1 / a)) if a > 0 else F.lit(0.0)
    elif d.method == 2:
        age = ratio / F.lit(math.exp(a))
    elif d.method == 3:
        age = ratio / F.lit(1 + math.log(a)) if a > 0 and 1 + math.log(a) > 0 else F.lit(-1.0)
    elif d.method == 4:
        age = F.when(ratio > 0, F.ln(ratio) / F.lit(a)).otherwise(F.lit(0.0)) if a else F.lit(0.0)
    elif d.method == 5:
        age = F.exp(F.least(ratio / F.lit(a), F.lit(700.0))) - F.lit(math.e) if a > 0 else F.lit(-1.0)
    elif d.method == 6:
        age = F.when(ratio > 1, F.lit(a) * (1 + F.ln(ratio - 1) / SIGMOID_STEEPNESS)).otherwise(F.lit(0.0)) if a else F.lit(0.0)
    else:
        return F.lit(-1.0)
    return F.when(at_horizon >= limit, F.lit(-1.0)).otherwise(F.greatest(age, F.lit(0.0)))


def days_until_forgotten(s: Column, age_days: Column, limit: float, d: Decay) -> Column:
    """0 when due, -1 for never."""
    crossing = crossing_units(s, limit, d)
    due = F.greatest(crossing * F.lit(d.unit_days), F.lit(float(d.minimum_age_days)), F.lit(float(d.retention_days)))
    return F.when(crossing < 0, F.lit(-1.0)).when(due <= age_days, F.lit(0.0)).otherwise(due - age_days)


def curve(spark, significance: float, d: Decay, limit: float, max_age_days: float = 0.0, points: int = 60):
    """(age_days, value) at evenly spaced ages; values that are not finite are left out."""
    if not 0 < points <= 500:
        raise ValueError("points must lie between 1 and 500")
    if max_age_days <= 0:
        crossing = spark.range(1).select(crossing_units(F.lit(significance), limit, d)).first()[0]
        max_age_days = (crossing * 1.5 if crossing > 0 else 30.0) * d.unit_days
    step = max_age_days / points
    rows = spark.range(1, points + 1).select((F.lit(step) * F.col("id")).alias("age_days"))
    rows = rows.withColumn("value", value(F.lit(float(significance)), F.col("age_days") / F.lit(d.unit_days), d))
    return rows.where(~F.isnan("value") & (F.abs("value") < float("inf")))
