"""Scalar column functions on text, numbers and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.times import text_time

# Fixed values.
PERCENT_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*%\s*$"
LABEL_LIMIT = 40
LABEL_KEEP = 38
ROI_DETAIL_FORMAT = (
    "%.2f cas/mois × %.2f min économisées/cas = %.2f min/mois = %.2f h/mois"
)

MICROS_PER_MINUTE = 60_000_000.0
MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_blank(c: Column | str) -> Column:
    """true when the text holds at least one non-space character; never null."""
    return F.coalesce(_col(c).rlike(r"(?U)\S"), F.lit(False))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def parse_percent(c: Column | str) -> Column:
    """C1: '72.5 %' -> 72.5; null when unreadable or above 100."""
    number = F.regexp_extract(_col(c), PERCENT_PATTERN, 1).try_cast("double")
    return F.when(number.between(0.0, 100.0), number)


def sanitize_id(c: Column | str) -> Column:
    """Lower-case identifier made of a-z, 0-9 and underscores."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9_]", "_")


def short_label(c: Column | str) -> Column:
    """At most 40 characters, longer labels end in '..'."""
    text = F.coalesce(_col(c), F.lit(""))
    cut = F.concat(F.substring(text, 1, LABEL_KEEP), F.lit(".."))
    return F.when(F.length(text) > LABEL_LIMIT, cut).otherwise(text)


def typed_label(label: Column | str, node_type: Column | str) -> Column:
    """C14: shortened label followed by the node type on a second line."""
    return F.concat(short_label(label), F.lit("\n["), F.upper(_col(node_type)), F.lit("]"))


def safe_double(c: Column | str) -> Column:
    """C4: number or null; NaN counts as null."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def word_count(c: Column | str) -> Column:
    """White-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(r"(?U)\S+")), F.lit(0))


def to_micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """(end - start) in minutes as a double."""
    return (to_micros(end) - to_micros(start)) / F.lit(MICROS_PER_MINUTE)


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """Floored day span."""
    return F.floor((to_micros(end) - to_micros(start)) / F.lit(MICROS_PER_DAY)).cast("long")


def round_to(c: Column | str, places: int = 2) -> Column:
    """Round the exact binary value, exact halves to even (2.675 -> 2.67).

    SQL ``round`` looks at the shortest decimal text and takes 2.675 up. The two differ
    only where that text is a half; there the sign of ``scale * x - k`` decides, formed
    without rounding error from the two halves of the mantissa.
    """
    x = _col(c).cast("double")
    scale = float(10 ** (places + 1))
    size = F.abs(x)
    k = F.rint(size * scale)
    spread = size * 134_217_729.0
    high = spread - (spread - size)
    side = (high * scale - k) + (size - high) * scale
    is_half = (k % 10 == 5) & (k / scale == size) & (size < 2.0**52 / scale)
    down, up = (k - 5) / scale, (k + 5) / scale
    even = F.when(((k - 5) / 10) % 2 == 0, down).otherwise(up)
    settled = F.when(side > 0, up).when(side < 0, down).otherwise(even) * F.signum(x)
    return F.when(is_half, settled).otherwise(F.round(x, places))


def as_timestamp(c: Column | str, dtype: T.DataType, day_first: bool = False) -> Column:
    """Timestamp or null. Plain numbers are nanoseconds since the epoch; ``day_first`` is how
    texts like 05/01/2024 read (see ``times``)."""
    col = _col(c)
    if isinstance(dtype, T.StringType):
        return text_time(col, day_first)
    if isinstance(dtype, T.NumericType):
        return F.timestamp_micros(F.floor(col / F.lit(1000)).cast("long"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    return F.lit(None).cast("timestamp")


def min_cluster_size(n: Column | str) -> Column:
    """Density threshold that grows with the logarithm of the row count."""
    count = _col(n).cast("double")
    return F.greatest(
        F.lit(2), F.coalesce(F.floor(F.log(F.when(count > 0, count)) * 1.5), F.lit(2))
    ).cast("int")


def roi_detail(
    volume: Column | str,
    saved_per_case: Column | str,
    saved_minutes: Column | str,
    saved_hours: Column | str,
) -> Column:
    """C11: one-line text of the saving calculation."""
    parts = [volume, saved_per_case, saved_minutes, saved_hours]
    return F.format_string(ROI_DETAIL_FORMAT, *[round_to(p) for p in parts])


def roi_assumptions(rate: Column, residual: Column, hourly: Column, cost: Column) -> Column:
    """Three parameter texts, and a fourth when a cost is given."""
    return F.array_compact(
        F.array(
            F.format_string("automation_rate=%.2f", round_to(rate)),
            F.format_string("residual_manual_time_minutes=%.2f", round_to(residual)),
            F.format_string("taux_horaire=%.2f", round_to(hourly)),
            F.when(cost.isNotNull(), F.format_string("implementation_cost=%.2f", round_to(cost))),
        )
    )
