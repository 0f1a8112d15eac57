"""Return on investment from time reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import non_blank, roi_assumptions, roi_detail, round_to
from tracemill.operators.metrics import METRICS
from tracemill.operators.rules import violations

# Modes, and the settings the application runs with.
ROI_MODES = ["full", "partial", "blocked"]
APPLICATION_RATE = 0.8
APPLICATION_RESIDUAL = 1.5
MONTHS = 12.0
# Half a cent on each side of annual = 12 x monthly when both are rounded.
ROUNDING_TOLERANCE = 0.065


def _number(value: float | str | Column | None) -> Column:
    col = value if isinstance(value, Column) else F.lit(value)
    return col.try_cast("double")


def roi_mode() -> Column:
    """Full, partial or blocked."""
    return (
        F.when(F.col("can_compute_full_roi"), "full")
        .when(F.col("can_compute_partial_roi"), "partial")
        .otherwise("blocked")
    )


def compute_roi(
    report: DataFrame,
    hourly: float | Column,
    automation_rate: float | Column = 1.0,
    residual: float | Column = 0.0,
    cost: float | Column | None = None,
) -> DataFrame:
    """Savings per process.

    Parameters are numbers or columns of ``report``. Where a guard fails, ``violation``
    names it and the numbers are null.
    """
    inputs = report.withColumns(
        {
            "_hourly": _number(hourly),
            "_rate": _number(automation_rate),
            "_residual": _number(residual),
            "_cost": _number(cost),
            "_volume": F.col("monthly_volume.value"),
            "_manual": F.col("manual_time_minutes.value"),
        }
    )
    guarded = inputs.withColumn("violation", _guard())
    saved = F.greatest(F.col("_manual") * F.col("_rate") - F.col("_residual"), F.lit(0.0))
    steps = (
        guarded.withColumn("_saved", F.when(F.col("violation").isNull(), saved))
        .withColumn("_minutes", F.col("_volume") * F.col("_saved"))
        .withColumn("_hours", F.col("_minutes") / 60.0)
        .withColumn("_monthly", F.col("_hours") * F.col("_hourly"))
    )
    valid = F.col("violation").isNull()
    confidence = F.struct(
        roi_mode().alias("roi_mode"),
        *[
            F.col(f"{m}.confidence_level").alias(m)
            for m in (
                "monthly_volume", "manual_time_minutes", "activity_duration_minutes",
                "case_cycle_time_minutes", "waiting_time_minutes",
            )
        ],
    )
    return steps.select(
        "process_id",
        round_to("_hours").alias("heures_economisees_par_mois"),
        round_to("_monthly").alias("economies_mensuelles"),
        round_to(F.col("_monthly") * MONTHS).alias("projection_annuelle"),
        F.when(F.col("_monthly") > 0, round_to(F.col("_cost") / F.col("_monthly"))).alias(
            "mois_retour_investissement"
        ),
        F.when(valid, roi_detail("_volume", "_saved", "_minutes", "_hours")).alias("detail_calcul"),
        F.when(
            valid,
            roi_assumptions(F.col("_rate"), F.col("_residual"), F.col("_hourly"), F.col("_cost")),
        ).alias("assumptions"),
        confidence.alias("confidence"),
        "violation",
    )


def _guard() -> Column:
    """First guard that fails, or null."""

    def bad(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(True))

    return (
        F.when(bad(F.col("_hourly") <= 0), "hourly_rate_not_positive")
        .when(bad(~F.col("_rate").between(0.0, 1.0)), "automation_rate_out_of_range")
        .when(bad(F.col("_residual") < 0), "residual_time_negative")
        .when(bad(~F.col("can_compute_partial_roi")), "roi_blocked")
        .when(bad(F.col("_volume") < 0), "monthly_volume_unusable")
        .when(bad(F.col("_manual") < 0), "manual_time_unusable")
    )


def roi_violations(roi: DataFrame, tol: float = ROUNDING_TOLERANCE) -> DataFrame:
    """Contract of the savings table. ``tol=0`` asks for annual = round(12 x monthly)."""
    numbers = ["heures_economisees_par_mois", "economies_mensuelles", "projection_annuelle"]
    rules = {f"{n}_invalid": F.col(n).isNull() for n in numbers}
    rules |= {f"{n}_negative": F.col(n) < 0 for n in numbers}
    expected = round_to(F.col("economies_mensuelles") * MONTHS)
    # A thousandth of a cent absorbs the binary error of the difference.
    rules["annual_not_12_months"] = (
        F.abs(round_to("projection_annuelle") - expected) > F.lit(tol + 1e-5)
    )
    rules["detail_blank"] = ~non_blank("detail_calcul")
    rules["roi_mode_invalid"] = ~F.coalesce(
        F.col("confidence.roi_mode").isin(ROI_MODES), F.lit(False)
    )
    return violations(roi, "roi", "process_id", None, rules)
