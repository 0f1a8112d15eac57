"""Checks and audits of time reports (V1, V2, V3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import non_blank
from tracemill.operators.metrics import (
    CRITICAL,
    LEVELS,
    METRICS,
    can_compute_full,
    can_compute_partial,
    metric_rows,
)
from tracemill.operators.rules import violations, warnings_array

# Accepted units, and the waiting / activity ratio that is flagged.
VOLUME_UNITS = ["cases/month", "items/month", "events/month"]
TIME_UNITS = ["minutes", "minute"]
WAITING_RATIO = 3
# End of fixed values.


def _blank_note(notes: Column) -> Column:
    return F.exists(notes, lambda n: ~non_blank(n))


def metric_violations(report: DataFrame) -> DataFrame:
    """V1, V2: rules of single metrics."""
    level, value = F.col("confidence_level"), F.col("value")
    is_missing = level == "missing"
    unit_ok = F.when(F.col("metric") == "monthly_volume", F.col("unit").isin(VOLUME_UNITS)).otherwise(
        F.col("unit").isin(TIME_UNITS)
    )
    rules = {
        "level_not_allowed": ~F.coalesce(level.isin(LEVELS), F.lit(False)),
        "missing_with_value": is_missing & value.isNotNull(),
        "value_absent": ~F.coalesce(is_missing, F.lit(False)) & value.isNull(),
        "value_negative": (value < 0) & ~F.coalesce(is_missing, F.lit(False)),
        "estimated_without_hypothesis": (level == "estimated") & ~non_blank("hypothesis"),
        "name_blank": ~non_blank("name"),
        "unit_blank": ~non_blank("unit"),
        "source_blank": ~non_blank("source"),
        "unit_unexpected": non_blank("unit") & ~unit_ok,
        "note_blank": _blank_note(F.col("notes")),
    }
    return violations(metric_rows(report), "metric", "process_id", "metric", rules)


def report_violations(report: DataFrame) -> DataFrame:
    """V1, V2: rules across the metrics of a report."""
    compared = [
        "activity_duration_minutes", "manual_time_minutes",
        "waiting_time_minutes", "case_cycle_time_minutes",
    ]
    present = ~F.array_contains(
        F.array(*[F.col(f"{m}.confidence_level") for m in compared]), "missing"
    )
    cycle = F.col("case_cycle_time_minutes.value")
    levels = [F.col(f"{m}.confidence_level") for m in CRITICAL]
    full, partial = F.col("can_compute_full_roi"), F.col("can_compute_partial_roi")
    rules = {
        "manual_above_cycle": present & (F.col("manual_time_minutes.value") > cycle),
        "activity_above_cycle": present & (F.col("activity_duration_minutes.value") > cycle),
        "waiting_above_cycle": present & (F.col("waiting_time_minutes.value") > cycle),
        "full_roi_flag_wrong": full & ~can_compute_full(levels),
        "partial_roi_flag_wrong": partial & ~can_compute_partial(levels),
        "full_without_partial": full & ~partial,
        "warning_blank": _blank_note(F.col("warnings")),
    }
    return violations(report, "time_report", "process_id", None, rules)


def time_violations(report: DataFrame) -> DataFrame:
    """V1: all rules of time reports."""
    return metric_violations(report).unionByName(report_violations(report))


def audit_time(report: DataFrame) -> DataFrame:
    """V3: estimated and missing metrics and warnings per process."""

    def names(level: str) -> Column:
        return F.array_compact(
            F.array(*[F.when(F.col(f"{m}.confidence_level") == level, F.lit(m)) for m in METRICS])
        )

    waiting, activity = F.col("waiting_time_minutes"), F.col("activity_duration_minutes")
    full, partial = F.col("can_compute_full_roi"), F.col("can_compute_partial_roi")
    rows = report.select(
        "process_id",
        names("estimated").alias("estimated"),
        names("missing").alias("missing"),
        (partial & ~full).alias("_partial"),
        (~partial).alias("_disabled"),
        (
            (activity["confidence_level"] != "missing")
            & (waiting["confidence_level"] != "missing")
            & (waiting["value"] > activity["value"] * WAITING_RATIO)
        ).alias("_bottleneck"),
    )
    return rows.select(
        "process_id",
        "estimated",
        "missing",
        warnings_array(
            {
                "estimated_metrics": F.size("estimated") > 0,
                "missing_metrics": F.size("missing") > 0,
                "partial_roi_only": F.col("_partial"),
                "roi_disabled": F.col("_disabled"),
                "waiting_far_above_activity": F.col("_bottleneck"),
            }
        ).alias("warnings"),
    )
