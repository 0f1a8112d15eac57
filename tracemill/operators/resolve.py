"""Time resolver: decide from the schema how a table's time can be measured."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.scalars import safe_double
from tracemill.operators.columns import (
    ACTIVITY_NAMES,
    CASE_NAMES,
    DAYS_NAMES,
    END_TIMESTAMP_NAMES,
    HOURS_NAMES,
    MINUTES_NAMES,
    START_TIMESTAMP_NAMES,
    TIMESTAMP_NAMES,
    named,
    pick_any_case,
)

# Fixed value: the case id given to tables without one.
GLOBAL_CASE = "global_case_1"


@dataclass(frozen=True)
class TimeContext:
    """What the resolver found; the columns name those of the returned table."""

    case: str  # A..F, or "none" without an activity column
    mode: str  # provided | observed | estimated | insufficient
    case_id_col: str | None = None
    activity_col: str | None = None
    timestamp_col: str | None = None
    start_timestamp_col: str | None = None
    end_timestamp_col: str | None = None
    duration_minutes_col: str | None = None
    can_run_workflow_analysis: bool = True
    can_run_time_quantification: bool = False
    requires_user_input: bool = False
    warnings: tuple[str, ...] = field(default=())
    user_message: str | None = None

    def report_path(self) -> str:
        """Which report applies: user_input, duration_column, event_log or none."""
        if self.mode == "provided" and self.timestamp_col is None:
            return "user_input"
        if self.duration_minutes_col is not None:
            return "duration_column"
        return "event_log" if self.can_run_time_quantification else "none"

    def as_row(self, spark: SparkSession) -> DataFrame:
        """The context as a one-row table."""
        names = [
            "mode", "case_id_col", "activity_col", "timestamp_col", "start_timestamp_col",
            "end_timestamp_col", "duration_minutes_col",
        ]
        flags = ["can_run_workflow_analysis", "can_run_time_quantification", "requires_user_input"]
        return spark.range(1).select(
            F.lit(self.case).alias("resolution"),
            *[F.lit(getattr(self, n)).cast("string").alias(n) for n in names],
            *[F.lit(getattr(self, n)).alias(n) for n in flags],
            F.array(*[F.lit(w) for w in self.warnings]).cast("array<string>").alias("warnings"),
        )


def has_minimum_user_metrics(user_metrics: dict | None) -> bool:
    """Monthly volume and manual minutes are both given."""
    given = user_metrics or {}
    return all(given.get(k) is not None for k in ("monthly_volume", "manual_time_minutes"))


def resolve_time_context(
    df: DataFrame, user_metrics: dict | None = None
) -> tuple[DataFrame, TimeContext]:
    """P8..P16: add canonical columns and describe them.

    Precedence: A timestamps, B minutes, C hours, D days, E user metrics, F nothing.
    """
    activity = pick_any_case(df.columns, ACTIVITY_NAMES)
    if activity is None:
        return df, TimeContext(
            case="none",
            mode="insufficient",
            warnings=("no activity column found, time is not measured",),
            user_message="the workflow can be analysed, but times cannot without an activity column",
        )
    case_id = pick_any_case(df.columns, CASE_NAMES)
    timestamp = pick_any_case(df.columns, TIMESTAMP_NAMES)
    added: dict[str, Column] = {"activity": named(activity)}

    if timestamp is not None:
        return _from_timestamps(df, added, case_id, timestamp)

    for case, names, factor, unit in (
        ("B", MINUTES_NAMES, 1.0, "minutes"),
        ("C", HOURS_NAMES, 60.0, "hours"),
        ("D", DAYS_NAMES, 1440.0, "days"),
    ):
        source = pick_any_case(df.columns, names)
        if source is None:
            continue
        added["duration_minutes"] = safe_double(named(source)) * F.lit(factor)
        added["case_id"] = F.lit(GLOBAL_CASE) if case_id is None else named(case_id)
        return _with(df, added), TimeContext(
            case=case,
            mode="estimated",
            case_id_col="case_id",
            activity_col="activity",
            duration_minutes_col="duration_minutes",
            can_run_time_quantification=True,
            warnings=(f"no timestamps, only a duration in {unit}: times stay partial",),
        )

    table = _with(df, added)
    if has_minimum_user_metrics(user_metrics):
        return table, TimeContext(
            case="E",
            mode="provided",
            activity_col="activity",
            can_run_time_quantification=True,
            warnings=("no time columns: the metrics given by the user are taken",),
        )
    return table, TimeContext(
        case="F",
        mode="insufficient",
        activity_col="activity",
        warnings=("no usable time data",),
        user_message="the workflow can be analysed, but time savings cannot be put in figures",
    )


def _from_timestamps(
    df: DataFrame, added: dict[str, Column], case_id: str | None, timestamp: str
) -> tuple[DataFrame, TimeContext]:
    start = pick_any_case(df.columns, START_TIMESTAMP_NAMES)
    end = pick_any_case(df.columns, END_TIMESTAMP_NAMES)
    added["timestamp"] = named(timestamp)
    if start is not None:
        added["start_timestamp"] = named(start)
    if end is not None:
        added["end_timestamp"] = named(end)
    added["case_id"] = F.lit(GLOBAL_CASE) if case_id is None else named(case_id)

    warnings = []
    if case_id is None:
        warnings.append("no case column: all rows form one case, cycle times are rough")
    if start is None:
        warnings.append("no start timestamp: activity durations cannot be observed")
    return _with(df, added), TimeContext(
        case="A",
        mode="estimated" if case_id is None or start is None else "observed",
        case_id_col="case_id",
        activity_col="activity",
        timestamp_col="timestamp",
        start_timestamp_col="start_timestamp" if start is not None else None,
        end_timestamp_col="end_timestamp" if end is not None else None,
        can_run_time_quantification=True,
        warnings=tuple(warnings),
    )


def _with(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Add columns, replacing any that differ only in case, in one projection."""
    taken = {name.lower() for name in added}
    kept = [named(c) for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[col.alias(name) for name, col in added.items()])
