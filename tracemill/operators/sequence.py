"""Neighbouring rows inside ordered groups, for groups of any size.

A group that fits one task uses a plain window. Larger groups are cut into
order-preserving chunks sized from their own statistics; the window then runs per chunk
and chunk ends are stitched from a summary with one row per chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import broadcast_if_small, checkpoint

# Rows one task sorts for a single group.
MAX_GROUP_ROWS = 4_000_000
_SPREAD = 16


def oversized(df: DataFrame, keys: list[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame | None:
    """Keys holding more than ``max_rows`` rows, checkpointed; None when there are none."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    big = sizes.filter(F.col("_rows") > max_rows)
    return None if big.isEmpty() else checkpoint(big)


def _cell(value: Column, low: Column, high: Column, cells: Column) -> Column:
    span = (high - low).cast("double")
    share = (value - low).cast("double") / F.nullif(span, F.lit(0.0))
    return F.coalesce(F.floor(share * cells), F.lit(0)).cast("long")


def chunked(
    rows: DataFrame, keys: list[str], split: list[str], max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add ``_chunk``: an array of cell numbers that sorts like the long columns ``split``.

    Cells are cut on the first column, and once that is constant, on the next.
    """
    out = rows.withColumn("_chunk", F.array().cast("array<long>"))
    while True:
        stats = out.groupBy(*keys, "_chunk").agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.min(c).alias(f"_lo_{c}") for c in split],
            *[F.max(c).alias(f"_hi_{c}") for c in split],
        )
        splittable = reduce(
            lambda a, b: a | b, [F.col(f"_lo_{c}") < F.col(f"_hi_{c}") for c in split]
        )
        big = checkpoint(stats.filter((F.col("_rows") > max_rows) & splittable))
        if big.isEmpty():
            return out
        cells = F.ceil(F.col("_rows") / F.lit(max_rows)) * _SPREAD
        step = None
        for c in reversed(split):
            here = _cell(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), cells)
            step = here if step is None else F.when(
                F.col(f"_lo_{c}") < F.col(f"_hi_{c}"), here
            ).otherwise(step)
        moved = F.when(
            F.col("_rows").isNotNull(), F.concat(F.col("_chunk"), F.array(step))
        ).otherwise(F.col("_chunk"))
        joined = out.join(broadcast_if_small(big), [*keys, "_chunk"], "left")
        out = joined.withColumn("_chunk", moved).select(*out.columns)


def along(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    split: list[str],
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    position: str | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add previous / next values and the 1-based position of each row in its group.

    ``order`` with the keys should identify a row; ``split`` is the leading part of it
    that holds longs and may be cut into cells. ``lag`` and ``lead`` map new column names
    to source columns.
    """
    lag, lead = lag or {}, lead or {}
    big = oversized(df, keys, max_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    added = [
        *[F.lag(src).over(window).alias(new) for new, src in lag.items()],
        *[F.lead(src).over(window).alias(new) for new, src in lead.items()],
        *([F.row_number().over(window).cast("long").alias(position)] if position else []),
    ]
    if big is None:
        return df.select("*", *added)
    marked = broadcast_if_small(big.select(*keys))
    small = df.join(marked, keys, "left_anti").select("*", *added)
    large = _along_chunks(
        chunked(df.join(marked, keys), keys, split, max_rows), keys, order, lag, lead, position
    )
    return small.unionByName(large.select(*small.columns))


def _along_chunks(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    lag: dict[str, str],
    lead: dict[str, str],
    position: str | None,
) -> DataFrame:
    part = [*keys, "_chunk"]
    window = Window.partitionBy(*part).orderBy(*order)
    inner = rows.select(
        "*",
        F.row_number().over(window).cast("long").alias("_pos"),
        *[F.lag(src).over(window).alias(f"_in_{new}") for new, src in lag.items()],
        *[F.lead(src).over(window).alias(f"_in_{new}") for new, src in lead.items()],
    )
    by = F.struct(*order)
    ends = rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_size"),
        *[F.max_by(src, by).alias(f"_end_{new}") for new, src in lag.items()],
        *[F.min_by(src, by).alias(f"_end_{new}") for new, src in lead.items()],
    )
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    seams = ends.select(
        *part,
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        *[F.lag(f"_end_{new}").over(over_chunks).alias(f"_out_{new}") for new in lag],
        *[F.lead(f"_end_{new}").over(over_chunks).alias(f"_out_{new}") for new in lead],
    )
    joined = inner.join(broadcast_if_small(checkpoint(seams)), part)
    first, last = F.col("_pos") == 1, F.col("_pos") == F.col("_size")
    out = joined
    for new in lag:
        out = out.withColumn(new, F.when(first, F.col(f"_out_{new}")).otherwise(F.col(f"_in_{new}")))
    for new in lead:
        out = out.withColumn(new, F.when(last, F.col(f"_out_{new}")).otherwise(F.col(f"_in_{new}")))
    if position:
        out = out.withColumn(position, F.col("_pos") + F.col("_offset"))
    return out
