"""Exact medians that never hold one group's values in one task.

Spark's ``median`` keeps a map of all distinct values of a group in one task. Here the
values are first collapsed to (key, value, count) across the cluster, and the middle
ranks are then located by narrowing: a coarse bucket, a fine bucket inside it, and the
few values left. Bucket codes are order-preserving pieces of the binary number (sign,
exponent, leading mantissa bits), so a bucket never splits equal values, a coarse bucket
holds a 1/65,536 slice of its power of two, and at most 2**18 distinct values remain at
the end whatever the distribution. Every branch reads the same counted exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COARSE = 65_536.0
_FINE = 262_144.0


def _codes(v: Column) -> tuple[Column, Column]:
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    exponent = (
        guess
        - F.when(size < F.pow(F.lit(2.0), guess), 1).otherwise(0)
        + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0)
    )
    scaled = (size / F.pow(F.lit(2.0), exponent) - 1.0) * _COARSE
    coarse = F.floor(scaled)
    sign = F.signum(v).cast("long")
    first = F.when(v != 0, sign * ((exponent + 1100) * int(_COARSE) + coarse))
    second = F.when(v != 0, sign * F.floor((scaled - coarse) * _FINE))
    # Never null, so no branch gets a filter of its own and all share one exchange.
    return (
        F.coalesce(first.cast("long"), F.lit(0).cast("long")),
        F.coalesce(second.cast("long"), F.lit(0).cast("long")),
    )


def _narrow(counts: DataFrame, group: list[str], code: str) -> DataFrame:
    """Buckets of ``group`` that hold a middle rank, with the rows before them."""
    outer = Window.partitionBy(*group)
    sums = counts.groupBy(*group, "_before", "_n", code).agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(outer.orderBy(code)) + F.col("_before")
    return (
        sums.withColumn("_upto", upto)
        .filter((F.col("_upto") > _low()) & (F.col("_upto") - F.col("_c") <= _high()))
        .select(*group, code, (F.col("_upto") - F.col("_c")).alias("_start"))
    )


def _low() -> Column:
    return F.floor((F.col("_n") - 1) / 2)


def _high() -> Column:
    return F.floor(F.col("_n") / 2)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Interpolated median of ``value`` per ``keys``, nulls and NaN skipped: (keys, out, n)."""
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")).na.drop()
    counts = clean.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    first, second = _codes(F.col("_v"))
    coded = counts.withColumn("_k1", first).withColumn("_k2", second)

    histogram = coded.groupBy(*keys, "_k1").agg(F.sum("_c").alias("_c"))
    per_key = Window.partitionBy(*keys)
    coarse = (
        histogram.withColumn("_n", F.sum("_c").over(per_key))
        .withColumn("_upto", F.sum("_c").over(per_key.orderBy("_k1")))
        .filter((F.col("_upto") > _low()) & (F.col("_upto") - F.col("_c") <= _high()))
        .select(*keys, "_k1", "_n", (F.col("_upto") - F.col("_c")).alias("_before"))
    )
    inside = coded.join(coarse, [*keys, "_k1"])
    fine = _narrow(inside, [*keys, "_k1"], "_k2")
    left = inside.join(fine, [*keys, "_k1", "_k2"]).drop("_before")
    ranked = left.withColumn(
        "_upto",
        F.sum("_c").over(Window.partitionBy(*keys, "_k1", "_k2").orderBy("_v")) + F.col("_start"),
    )
    holds_low = (F.col("_upto") > _low()) & (F.col("_upto") - F.col("_c") <= _low())
    holds_high = (F.col("_upto") > _high()) & (F.col("_upto") - F.col("_c") <= _high())
    return ranked.groupBy(*keys).agg(
        (
            (F.max(F.when(holds_low, F.col("_v"))) + F.max(F.when(holds_high, F.col("_v")))) / 2
        ).alias(out),
        F.max("_n").alias("n"),
    )
