"""Violations tables: (scope_id, subject_kind, subject_id, rule).

``scope_id`` is the process or workflow, ``subject_id`` the element inside it. A check
never fails a job; it returns the rows that break a rule, for all scopes at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = ["scope_id", "subject_kind", "subject_id", "rule"]


def violations(
    df: DataFrame, kind: str, scope: str, subject: str | Column | None, rules: dict[str, Column]
) -> DataFrame:
    """One row per row of ``df`` and rule whose condition is true; all rules in one scan."""
    if subject is None:
        subject_col = F.col(scope)
    else:
        subject_col = F.col(subject) if isinstance(subject, str) else subject
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(
        F.col(scope).cast("string").alias("scope_id"),
        F.lit(kind).alias("subject_kind"),
        subject_col.cast("string").alias("subject_id"),
        F.explode(broken).alias("rule"),
    )


def warnings_array(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def missing_references(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """J1..J6 shape: rows of ``child`` whose key is absent from ``parent``; null keys pass.

    ``on`` maps child columns to parent columns.
    """
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(on.values())]).distinct()
    cond = reduce(
        lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(on)]
    )
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return child.filter(known).join(keys, cond, "left_anti")


def uncovered(parent: DataFrame, child: DataFrame, on: dict[str, str]) -> DataFrame:
    """J7, J8 shape: rows of ``parent`` (columns ``on`` keys) that no ``child`` row names."""
    keys = child.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(on.values())]).distinct()
    cond = reduce(
        lambda a, b: a & b, [F.col(p) == F.col(f"_c{i}") for i, p in enumerate(on)]
    )
    return parent.join(keys, cond, "left_anti")


def all_violations_by_scope(found: DataFrame) -> DataFrame:
    """Number of violations per scope and rule."""
    return found.groupBy("scope_id", "rule").agg(F.count(F.lit(1)).alias("violations"))
