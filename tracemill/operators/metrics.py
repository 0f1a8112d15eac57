"""Time metrics with their level of confidence, one report row per process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import round_to
from tracemill.operators.mining import MAX_PATH_EVENTS, duration_summary, monthly_volume, process_measures

# Metric names with their units, levels and the critical metrics.
UNITS = {
    "monthly_volume": "cases/month",
    "activity_duration_minutes": "minutes",
    "case_cycle_time_minutes": "minutes",
    "manual_time_minutes": "minutes",
    "waiting_time_minutes": "minutes",
}
LEVELS = ["provided", "observed", "estimated", "missing"]
CRITICAL = ["monthly_volume", "activity_duration_minutes", "manual_time_minutes"]
SHORT_WINDOW_DAYS = 28
# End of fixed values.

METRICS = list(UNITS)
_SHAPE = (
    "struct<name:string,unit:string,value:double,confidence_level:string,"
    "source:string,hypothesis:string,notes:array<string>>"
)


def _text(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def metric(
    name: str,
    value: Column,
    level: str,
    source: str,
    note: Column | str,
    hypothesis: Column | str | None = None,
    unit: str | None = None,
) -> Column:
    """A present metric."""
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(unit or UNITS[name]).alias("unit"),
        value.cast("double").alias("value"),
        F.lit(level).alias("confidence_level"),
        F.lit(source).alias("source"),
        _text(hypothesis).alias("hypothesis"),
        F.array(_text(note)).alias("notes"),
    ).cast(_SHAPE)


def missing(name: str, source: str, note: str) -> Column:
    """M1: a metric without value."""
    return metric(name, F.lit(None), "missing", source, note)


def observed_or_missing(name: str, value: Column, found: str, absent: str) -> Column:
    """M2: measured from the event log when there is a value."""
    return F.when(
        value.isNotNull(), metric(name, round_to(value), "observed", "event_log", found)
    ).otherwise(missing(name, "event_log", absent))


def provided(name: str, value: Column, otherwise: Column) -> Column:
    """M4: the user's value wins."""
    return F.when(
        value.isNotNull(), metric(name, value, "provided", "user_input", "given by the user")
    ).otherwise(otherwise)


def manual_time(activity: Column, user_value: Column) -> Column:
    """M3: user value, else the observed activity duration as an estimate, else missing."""
    proxy = metric(
        "manual_time_minutes",
        activity["value"],
        "estimated",
        "rule_engine",
        "replace by a measured manual time",
        "manual time taken as the observed activity duration",
    )
    absent = missing("manual_time_minutes", "rule_engine", "no manual time given or derivable")
    return provided(
        "manual_time_minutes",
        user_value,
        F.when(activity["confidence_level"] == "observed", proxy).otherwise(absent),
    )


def can_compute_full(levels: list[Column]) -> Column:
    """M5: every critical metric is provided or observed."""
    return _all([lv.isin("provided", "observed") for lv in levels])


def can_compute_partial(levels: list[Column]) -> Column:
    """M5: no critical metric is missing."""
    return _all([lv.isin("provided", "observed", "estimated") for lv in levels])


def _all(flags: list[Column]) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out & flag
    return out


def assemble_report(df: DataFrame, warnings: Column) -> DataFrame:
    """M6: (process_id, five metrics, warnings, two flags)."""
    levels = [F.col(f"{m}.confidence_level") for m in CRITICAL]
    return df.select(
        "process_id",
        *METRICS,
        warnings.cast("array<string>").alias("warnings"),
        can_compute_full(levels).alias("can_compute_full_roi"),
        can_compute_partial(levels).alias("can_compute_partial_roi"),
    )


def _with_user(df: DataFrame, user_metrics: DataFrame | None) -> DataFrame:
    """Left join of user values as ``u_<metric>`` columns."""
    if user_metrics is None:
        return df.select("*", *[F.lit(None).cast("double").alias(f"u_{m}") for m in METRICS])
    return df.join(_user_values(user_metrics), "process_id", "left")


def _user_values(user_metrics: DataFrame) -> DataFrame:
    given = [
        (F.col(m).cast("double") if m in user_metrics.columns else F.lit(None).cast("double")).alias(f"u_{m}")
        for m in METRICS
    ]
    return user_metrics.select("process_id", *given)


def _volume_metric() -> Column:
    days = F.col("days").cast("string")
    short = F.col("days") < SHORT_WINDOW_DAYS
    found = metric(
        "monthly_volume",
        F.col("monthly_volume"),
        "estimated",
        "rule_engine",
        F.when(short, F.lit("short window, treat the projection with care")).otherwise(
            F.concat(F.col("cases").cast("string"), F.lit(" cases over "), days, F.lit(" days"))
        ),
        F.concat(
            F.when(short, F.lit("short-window ")).otherwise(F.lit("")),
            F.lit("monthly projection from "), days, F.lit(" observed days"),
        ),
    )
    absent = missing("monthly_volume", "rule_engine", "no usable timestamp")
    return F.when(F.col("cases") > 0, found).otherwise(absent)


def report_from_log(
    log: DataFrame,
    user_metrics: DataFrame | None = None,
    processes: DataFrame | None = None,
    max_events: int = MAX_PATH_EVENTS,
) -> DataFrame:
    """M8: time report of event logs.

    ``user_metrics`` holds (process_id, any of the five metrics); null means not given.
    ``processes`` may name processes that must appear even without usable events.
    """
    measured = process_measures(log, max_events).join(monthly_volume(log), "process_id", "left")
    if processes is not None:
        measured = processes.select("process_id").distinct().join(measured, "process_id", "left")
    base = _with_user(measured, user_metrics).withColumns(
        {
            "m_volume": _volume_metric(),
            "m_activity": observed_or_missing(
                "activity_duration_minutes", F.col("activity_minutes"),
                "median over activities of the mean duration", "no start timestamps to measure from",
            ),
            "m_cycle": observed_or_missing(
                "case_cycle_time_minutes", F.col("cycle_minutes"),
                "median over cases", "no case duration",
            ),
            "m_waiting": observed_or_missing(
                "waiting_time_minutes", F.col("waiting_minutes"),
                "median between successive events of a case", "no successive events",
            ),
        }
    )
    skipped = F.when(
        ~F.coalesce(F.col("has_start"), F.lit(False)),
        F.lit("activity duration skipped: no start timestamp"),
    )
    parts = base.select(
        "process_id",
        skipped.alias("_skipped"),
        provided("monthly_volume", F.col("u_monthly_volume"), F.col("m_volume")).alias("monthly_volume"),
        provided(
            "activity_duration_minutes", F.col("u_activity_duration_minutes"), F.col("m_activity")
        ).alias("activity_duration_minutes"),
        provided(
            "case_cycle_time_minutes", F.col("u_case_cycle_time_minutes"), F.col("m_cycle")
        ).alias("case_cycle_time_minutes"),
        manual_time(F.col("m_activity"), F.col("u_manual_time_minutes")).alias("manual_time_minutes"),
        provided(
            "waiting_time_minutes", F.col("u_waiting_time_minutes"), F.col("m_waiting")
        ).alias("waiting_time_minutes"),
    )
    return assemble_report(parts, F.array_compact(F.array("_skipped")))


def report_from_durations(durations: DataFrame, user_metrics: DataFrame | None = None) -> DataFrame:
    """M9: time report of duration logs. Volume and manual time may be given by the user."""
    base = _with_user(duration_summary(durations), user_metrics)
    activity = metric(
        "activity_duration_minutes", F.col("median_minutes"), "estimated", "source_duration_column",
        "no start and end timestamps", "median of the stated durations",
    )
    parts = base.select(
        "process_id",
        provided(
            "monthly_volume",
            F.col("u_monthly_volume"),
            metric(
                "monthly_volume", F.col("cases"), "estimated", "rule_engine",
                "no timestamps to scale to a month", "number of cases in the sample",
            ),
        ).alias("monthly_volume"),
        activity.alias("activity_duration_minutes"),
        metric(
            "case_cycle_time_minutes", F.col("total_minutes"), "estimated", "source_duration_column",
            "without case timestamps the cycle is approximate", "sum of the stated durations",
        ).alias("case_cycle_time_minutes"),
        manual_time(activity, F.col("u_manual_time_minutes")).alias("manual_time_minutes"),
        missing("waiting_time_minutes", "rule_engine", "no timestamps to measure waits").alias(
            "waiting_time_minutes"
        ),
    )
    return assemble_report(parts, F.array(F.lit("report built from a stated duration column")))


def report_from_user(user_metrics: DataFrame) -> DataFrame:
    """Time report of user values only (process_id, monthly_volume, ...)."""
    base = _user_values(user_metrics)
    manual, waiting = F.col("u_manual_time_minutes"), F.col("u_waiting_time_minutes")

    def given(name: str) -> Column:
        return provided(name, F.col(f"u_{name}"), missing(name, "user_input", "not given")).alias(name)

    parts = base.select(
        "process_id",
        given("monthly_volume"),
        F.when(
            manual.isNotNull(),
            metric(
                "activity_duration_minutes", manual, "estimated", "rule_engine",
                "replace by measured timestamps", "activity taken as the given manual time",
            ),
        )
        .otherwise(missing("activity_duration_minutes", "rule_engine", "no source data"))
        .alias("activity_duration_minutes"),
        F.when(
            manual.isNotNull() & waiting.isNotNull(),
            metric(
                "case_cycle_time_minutes", manual + waiting, "estimated", "rule_engine",
                "approximated from user values", "given manual time plus given waiting time",
            ),
        )
        .otherwise(missing("case_cycle_time_minutes", "rule_engine", "not derivable"))
        .alias("case_cycle_time_minutes"),
        given("manual_time_minutes"),
        given("waiting_time_minutes"),
    )
    return assemble_report(parts, F.array(F.lit("report built from user metrics")))


def metric_rows(report: DataFrame) -> DataFrame:
    """One row per process and metric: (process_id, metric, name, unit, value, ...)."""
    items = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("body")) for m in METRICS]
    )
    return report.select("process_id", F.explode(items).alias("_m")).select(
        "process_id", "_m.metric", "_m.body.*"
    )


def precision(report: DataFrame) -> DataFrame:
    """Counts of the four levels and the resulting precision class."""
    def at(level: str) -> Column:
        hits = [F.when(F.col(f"{m}.confidence_level") == level, 1).otherwise(0) for m in METRICS]
        return sum(hits[1:], hits[0]).cast("long")

    counted = report.select("process_id", *[at(lv).alias(f"{lv}_count") for lv in LEVELS])
    return counted.withColumn(
        "precision",
        F.when(F.col("missing_count") > 0, "partial")
        .when(F.col("estimated_count") > 0, "approximate")
        .otherwise("precise"),
    )
