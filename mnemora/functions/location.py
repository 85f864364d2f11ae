"""Familiarity, co-access and activity of locations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by which an activity is inferred, in order of precedence, with the confidence (fixed values).
ACTIVITIES = (
    ("debugging", ("debug", "fix", "bug", "issue", "error", "trace"), 0.9),
    ("refactoring", ("refactor", "clean", "reorganize", "restructure"), 0.9),
    ("reviewing", ("review", "understand", "check", "examine", "audit"), 0.8),
    ("writing", ("implement", "add", "create", "write", "build"), 0.7),
    ("reading", ("read", "look", "see", "view", "inspect"), 0.6),
)


def familiarity(accesses: Column) -> Column:
    return 1.0 - 1.0 / (1.0 + 0.1 * accesses)


def well_known(f: Column) -> Column:
    return f >= 0.7


def floor_of(f: Column) -> Column:
    return 0.1 + F.when(f > 0.5, 0.4 * (f - 0.5)).otherwise(0.0)


def decayed(f: Column, days: Column, pinned: Column, stale_days: float = 30.0) -> Column:
    """One step of decay; pinned, fresh and damaged values stay."""
    step = F.greatest(floor_of(f), f * (1.0 - 0.1 * (1.0 - 0.8 * f)))
    return F.when(pinned | F.isnan(f) | (days < stale_days) | days.isNull(), f).otherwise(step)


def multiplier(same_task: Column, same_activity: Column) -> Column:
    return F.when(same_task & same_activity, 5.0).when(same_task, 3.0).when(same_activity, 2.0).otherwise(1.0)


def association_strength(count: Column, times: Column | float = 1.0) -> Column:
    return 1.0 - 1.0 / (1.0 + 0.1 * count * times)


def activity(context: Column, tool: Column | None = None, explicit: Column | None = None) -> Column:
    """struct(activity, source, confidence): what was said outright, else by keyword, then tool, then default."""
    lower = F.lower(F.coalesce(context, F.lit("")))

    def made(name: str | Column, source: str, confidence: float) -> Column:
        named = F.lit(name) if isinstance(name, str) else name
        return F.struct(named.alias("activity"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))

    out = F.when(F.lit(False), made("", "", 0.0))
    if explicit is not None:
        out = out.when(explicit != "unknown", made(explicit, "explicit", 1.0))
    for name, words, confidence in ACTIVITIES:
        out = out.when(lower.rlike("|".join(words)), made(name, "keyword", confidence))
    if tool is not None:
        out = out.when(tool.isin("Read", "Grep", "Glob"), made("reading", "tool", 0.5)).when(tool.isin("Edit", "Write"), made("writing", "tool", 0.5))
    return out.otherwise(made("unknown", "default", 0.0))
