"""Activation, decay and reconsolidation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.config import DAY_MS, DECAY_DAYS, ENCODING, NOISE_BASE, RECONSOLIDATION, WORKING_MEMORY

NO_HISTORY = -10.0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def base_level(age_ms: Column, decay: Column | float = 0.5) -> Column:
    """Aggregate: log of the decayed sum of accesses, each at least a second old."""
    rate = F.lit(decay) if isinstance(decay, float) else decay
    return F.ln(F.sum(F.pow(F.greatest(age_ms / 1000.0, F.lit(1.0)), -rate)))


def cubed(s: Column) -> Column:
    return s * s * s


def combined(base: Column, probe: Column, spread: Column, emotion: Column) -> Column:
    recency = clamp((base + 10.0) / 10.0, 0.0, 1.0)
    return probe * (1.0 + (emotion - 0.5)) * (1.0 + recency) + spread


def probability(activation: Column, threshold: float, noise: Column | float) -> Column:
    return 1.0 / (1.0 + F.exp((threshold - activation) / noise))


def latency_ms(activation: Column, factor: float = 1.0) -> Column:
    return factor * F.exp(-activation) * 1000.0


def working_memory_boost(age_ms: Column) -> Column:
    return F.when(age_ms < 0, 1.0).otherwise(1.0 + WORKING_MEMORY["max_boost"] * F.exp(-age_ms / WORKING_MEMORY["decay_ms"]))


def session_decay(age_ms: Column) -> Column:
    """Decay rate by the time since the last access: 0.3, 0.4, 0.45, 0.5."""
    hours = age_ms / 3_600_000.0
    return F.when(hours < 0, 0.5).when(hours < 0.5, 0.3).when(hours < 2, 0.4).when(hours < 24, 0.45).otherwise(0.5)


def encoding_strength(attention: Column, emotion: Column, accesses: Column) -> Column:
    e = ENCODING
    return clamp(e["base"] + e["attention"] * attention + e["emotion"] * emotion + e["rehearsal"] * F.least(accesses, F.lit(e["most"])) / e["most"], 0.0, 1.0)


def instance_noise(strength: Column, base: float = NOISE_BASE) -> Column:
    return base * (2.0 - strength)


def decay_days(state: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, days in DECAY_DAYS.items():
        out = out.when(state == name, days)
    return out.otherwise(DECAY_DAYS["fresh"])


def association_decay(strength: Column, age_ms: Column, state: Column) -> Column:
    return strength * F.exp(-(age_ms / float(DAY_MS)) / decay_days(state))


def reinforced(strength: Column, by: float = 0.05) -> Column:
    return F.least(F.lit(1.0), strength + by)


def thresholds(accesses: Column, days: Column) -> tuple[Column, Column]:
    low = RECONSOLIDATION["low"] + 0.05 * F.least(days, F.lit(5.0))
    high = F.greatest(RECONSOLIDATION["high"] - 0.15 * F.least(accesses / 5.0, F.lit(3.0)), low + 0.05)
    return low, high


def reconsolidation_probability(error: Column, low: Column | float, high: Column | float) -> Column:
    b = RECONSOLIDATION["beta"]
    first = 1.0 / (1.0 + F.exp(-b * (F.abs(error) - low)))
    second = 1.0 / (1.0 + F.exp(-b * (F.abs(error) - high)))
    return first * (1.0 - second)


def error_zone(error: Column, low: Column, high: Column) -> Column:
    return F.when(error < low, "reinforce").when(error < high, "reconsolidate").otherwise("new_trace")


def surprise(similarity: Column, days: Column, strength: Column, base: float = 0.5) -> Column:
    return F.least(F.lit(1.0), (1.0 - similarity) / (base + 0.01 * days + 0.2 * strength))


def project_boost(emotion: Column, same_project: Column, by: float = 0.15) -> Column:
    return F.when(same_project, F.least(emotion + by, F.lit(1.0))).otherwise(emotion)


def link_strength(distance: Column, base: float, rate: float = 0.3) -> Column:
    return base * F.exp(-rate * distance)
