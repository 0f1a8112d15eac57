"""Times written in many forms.

A form with one reading is tried value by value. Numbers like 05/01/2024 have two, so their order is
a property of the column: the order in which more of its values are times, month first when both read
as many, as they do where no day is above 12.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What may follow a date, and dates with one reading.
CLOCKS = ("[ H:mm[:ss[.SSSSSS][.SSS]]]", " h:mm[:ss] a")
CLEAR_DATES = ("yyyy/M/d", "yyyy.M.d", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy")
PACKED = ("yyyyMMdd", "yyyyMMdd HHmmss", "yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss")
DAY_FIRST_DATES = ("d/M/yyyy", "d/M/yy")
MONTH_FIRST_DATES = ("M/d/yyyy", "M/d/yy")
_TWO_READINGS = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?=\D|$)"


def _first(text: Column, dates: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(d + clock)) for d in dates for clock in CLOCKS])


def _tidy(c: Column) -> Column:
    """Without outer white space; one blank between date and clock."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.regexp_replace(text, r"^(\d{1,4}[./-]\d{1,2}[./-]\d{1,4})(?:T|, )(?=\d)", "$1 ")


def _slashed(text: Column) -> Column:
    """A date of two readings, its parts divided by slashes; null for other texts."""
    return F.when(text.rlike(_TWO_READINGS), F.regexp_replace(text, _TWO_READINGS, "$1/$2/$3"))


def clear_time(c: Column) -> Column:
    """A text with one reading as a time: ISO forms, year first, named months, packed digits."""
    text = _tidy(c)
    packed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in PACKED])
    words = F.when(text.rlike("[A-Za-z]{3}|^[0-9]{4}[./]"), _first(text, CLEAR_DATES))
    iso = F.try_to_timestamp(F.when(~text.rlike(r"^\d{5,}$"), text))
    return F.coalesce(iso, F.when(text.rlike(r"^\d{8}"), packed), words)


def slash_time(c: Column, day_first: bool) -> Column:
    """A date of two readings, with or without a clock, in the given order."""
    return _first(_slashed(_tidy(c)), DAY_FIRST_DATES if day_first else MONTH_FIRST_DATES)


def text_time(c: Column, day_first: bool = False) -> Column:
    return F.coalesce(clear_time(c), slash_time(c, day_first))


@dataclass(frozen=True)
class TimeForm:
    """How the texts of one column read as times."""

    day_first: bool
    values: int
    unread: int
    doubtful: int  # values that read differently in the other order, where the column does not tell

    def warnings(self, column: str) -> tuple[str, ...]:
        out = []
        if self.unread:
            out.append(f"{self.unread} of {self.values} values of {column} are no times and count as missing")
        if self.doubtful:
            out.append(f"{self.doubtful} values of {column} read as day first or month first alike: month first is taken")
        return tuple(out)


def time_forms(df: DataFrame, columns: list[str]) -> dict[str, TimeForm]:
    """The form of each text column among ``columns``; one aggregate over all of them, one row of counts."""
    texts = [c for c in dict.fromkeys(columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return {}
    counts = []
    for i, name in enumerate(texts):
        c = F.col("`" + name.replace("`", "``") + "`")
        day, month = slash_time(c, True), slash_time(c, False)
        counts += [
            F.count(F.when(c.rlike(r"(?U)\S"), 1)).alias(f"n{i}"), F.count(clear_time(c)).alias(f"clear{i}"),
            F.count(day).alias(f"day{i}"), F.count(month).alias(f"month{i}"), F.count(F.when(day != month, 1)).alias(f"differ{i}"),
        ]
    told = df.agg(*counts).first()
    out = {}
    for i, name in enumerate(texts):
        day, month = told[f"day{i}"], told[f"month{i}"]
        read = told[f"clear{i}"] + max(day, month)
        out[name] = TimeForm(day > month, told[f"n{i}"], told[f"n{i}"] - read, told[f"differ{i}"] if day == month else 0)
    return out
