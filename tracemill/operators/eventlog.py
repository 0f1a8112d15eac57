"""Event log and duration log construction.

Every operator downstream works on many processes at once and expects
(process_id, case_id, activity, timestamp, start_timestamp?, end_timestamp?, tiebreak).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import as_timestamp, safe_double
from tracemill.functions.times import TimeForm, time_forms
from tracemill.operators.columns import named, require


def event_log(
    df: DataFrame,
    case_id: str = "case_id",
    activity: str = "activity",
    timestamp: str = "timestamp",
    start: str | None = None,
    end: str | None = None,
    tiebreak: Column | str | None = None,
    process: Column | str = "process",
    forms: dict[str, TimeForm] | None = None,
) -> DataFrame:
    """P18 + P19 + F2: typed event log without rows that lack case, activity or time.

    Where time columns are texts, one aggregate tells their order of day and month;
    ``forms`` brings it from before.

    ``process`` is a column, or a literal name for a single-process table. ``tiebreak``
    orders events of one case that share a timestamp; without it the activity does.
    """
    require(df, [case_id, activity, timestamp])
    types = {f.name: f.dataType for f in df.schema.fields}
    process_col = F.lit(process) if isinstance(process, str) else process
    tie = F.lit(0) if tiebreak is None else (named(tiebreak) if isinstance(tiebreak, str) else tiebreak)

    told = time_forms(df, [c for c in (timestamp, start, end) if c in types]) if forms is None else forms

    def moment(name: str | None) -> Column:
        if name is None or name not in types:
            return F.lit(None).cast("timestamp")
        return as_timestamp(named(name), types[name], name in told and told[name].day_first)

    rows = _present(df, [case_id, activity, timestamp]).select(
        process_col.cast("string").alias("process_id"),
        named(case_id).cast("string").alias("case_id"),
        named(activity).cast("string").alias("activity"),
        moment(timestamp).alias("timestamp"),
        moment(start).alias("start_timestamp"),
        moment(end).alias("end_timestamp"),
        tie.cast("long").alias("tiebreak"),
    )
    return rows.filter(F.col("process_id").isNotNull() & F.col("timestamp").isNotNull())


def _present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null in ``columns``; on source columns the scan takes the filter."""
    for c in columns:
        df = df.filter(named(c).isNotNull())
    return df


def duration_log(
    df: DataFrame,
    case_id: str = "case_id",
    activity: str = "activity",
    duration: str = "duration_minutes",
    process: Column | str = "process",
) -> DataFrame:
    """P18 + F3: (process_id, case_id, activity, duration_minutes), complete rows only."""
    require(df, [case_id, activity, duration])
    process_col = F.lit(process) if isinstance(process, str) else process
    return _present(df, [case_id, activity, duration]).select(
        process_col.cast("string").alias("process_id"),
        named(case_id).cast("string").alias("case_id"),
        named(activity).cast("string").alias("activity"),
        safe_double(named(duration)).alias("duration_minutes"),
    ).filter(F.col("duration_minutes").isNotNull())


def processes_without_rows(processes: DataFrame, log: DataFrame) -> DataFrame:
    """processes of ``processes`` that keep no usable row in ``log``."""
    kept = log.select("process_id").distinct()
    return processes.select("process_id").distinct().join(kept, "process_id", "left_anti")
