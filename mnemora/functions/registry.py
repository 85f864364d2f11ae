"""The column functions under names for SQL, as SQL functions that the optimizer inlines; no Python runs in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body of each function; the bodies say what the columns of the same name do.
FUNCTIONS: tuple[tuple[str, str, str, str], ...] = (
    ("mem_cubed", "s DOUBLE", "DOUBLE", "s * s * s"),
    ("mem_combined", "b DOUBLE, probe DOUBLE, spread DOUBLE, emotion DOUBLE", "DOUBLE", "probe * (1 + (emotion - 0.5)) * (1 + least(greatest((b + 10) / 10, 0), 1)) + spread"),
    ("mem_probability", "activation DOUBLE, threshold DOUBLE, noise DOUBLE", "DOUBLE", "1 / (1 + exp((threshold - activation) / noise))"),
    ("mem_latency", "activation DOUBLE", "DOUBLE", "exp(-activation) * 1000"),
    ("mem_noise", "strength DOUBLE", "DOUBLE", "0.25D * (2 - strength)"),
    ("mem_boost", "age_ms DOUBLE", "DOUBLE", "CASE WHEN age_ms < 0 THEN 1 ELSE 1 + exp(-age_ms / 4000) END"),
    ("mem_session_decay", "age_ms DOUBLE", "DOUBLE", "CASE WHEN age_ms < 0 THEN 0.5D WHEN age_ms < 1800000 THEN 0.3D WHEN age_ms < 7200000 THEN 0.4D WHEN age_ms < 86400000 THEN 0.45D ELSE 0.5D END"),
    ("mem_encoding", "attention DOUBLE, emotion DOUBLE, accesses BIGINT", "DOUBLE", "least(greatest(0.3D + 0.2D * attention + 0.2D * emotion + 0.3D * least(accesses, 10) / 10, 0), 1)"),
    ("mem_reinforced", "strength DOUBLE", "DOUBLE", "least(1, strength + 0.05D)"),
    ("mem_zone", "error DOUBLE, low DOUBLE, high DOUBLE", "STRING", "CASE WHEN error < low THEN 'reinforce' WHEN error < high THEN 'reconsolidate' ELSE 'new_trace' END"),
    ("mem_surprise", "similarity DOUBLE, days DOUBLE, strength DOUBLE", "DOUBLE", "least(1, (1 - similarity) / (0.5D + 0.01D * days + 0.2D * strength))"),
    ("mem_familiarity", "accesses BIGINT", "DOUBLE", "1 - 1 / (1 + 0.1D * accesses)"),
    ("mem_association", "weight DOUBLE", "DOUBLE", "1 - 1 / (1 + 0.1D * weight)"),
    ("mem_link", "distance BIGINT, base DOUBLE", "DOUBLE", "base * exp(-0.3D * distance)"),
    ("mem_visual_weight", "arousal DOUBLE", "DOUBLE", "0.5D + least(greatest(arousal, 0), 1)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
