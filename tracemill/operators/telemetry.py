"""Run telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import round_to


def record(usage: DataFrame) -> DataFrame:
    """(run_id, agent_name, latency, counters) with rounded latency, absent counters 0."""
    counters = ["prompt_tokens", "completion_tokens", "total_tokens"]
    zero = F.lit(0).cast("long")
    return usage.select(
        "run_id",
        "agent_name",
        round_to("latency_seconds", 3).alias("latency_seconds"),
        *[
            (F.coalesce(F.col(c).cast("long"), zero) if c in usage.columns else zero).alias(c)
            for c in counters
        ],
    )


def telemetry_summary(usage: DataFrame) -> DataFrame:
    """Totals per run. The total is prompt + completion, whatever was recorded."""
    return record(usage).groupBy("run_id").agg(
        round_to(F.sum("latency_seconds"), 3).alias("total_latency_seconds"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"),
    )
