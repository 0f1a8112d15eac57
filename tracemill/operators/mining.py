"""Process-mining measures on event logs and duration logs.

All results carry ``process_id``. Group-wise work is either a mergeable aggregate (so a
process holding most rows is combined before the shuffle), an exact distributed median,
or a case window that splits oversized cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import minutes_between, round_to, whole_days_between
from tracemill.operators.median import exact_median
from tracemill.operators.sequence import MAX_GROUP_ROWS, along, oversized
from tracemill.session import broadcast_if_small, checkpoint

CASE = ["process_id", "case_id"]


def _ordered(log: DataFrame) -> DataFrame:
    """Time and tiebreak as long columns; the activity settles full ties."""
    return log.select(
        *CASE,
        "activity",
        "timestamp",
        F.unix_micros("timestamp").alias("_at"),
        F.col("tiebreak").alias("_tie"),
    )


# Events of a case held as one array; longer cases are followed row by row.
MAX_PATH_EVENTS = 100_000
_SPLIT = ["_at", "_tie"]
_ORDER = [*_SPLIT, "activity"]


def monthly_volume(log: DataFrame) -> DataFrame:
    """A1: cases, observed days and cases per 30 days."""
    bounds = log.groupBy("process_id").agg(
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
        F.countDistinct("case_id").alias("cases"),
    )
    days = F.greatest(whole_days_between("_first", "_last") + 1, F.lit(1))
    return bounds.select(
        "process_id",
        "cases",
        days.alias("days"),
        round_to(F.col("cases") / days * 30.0).alias("monthly_volume"),
    )


def sojourn_by_activity(log: DataFrame) -> DataFrame:
    """A2, first level: mean minutes from start to timestamp per activity."""
    spent = log.filter(F.col("start_timestamp").isNotNull()).select(
        "process_id", "activity", minutes_between("start_timestamp", "timestamp").alias("_minutes")
    )
    return spent.groupBy("process_id", "activity").agg(
        F.avg("_minutes").alias("mean_minutes"), F.count(F.lit(1)).alias("events")
    )


def activity_duration(log: DataFrame) -> DataFrame:
    """A2: median over activities of the non-negative mean minutes."""
    means = sojourn_by_activity(log).filter(F.col("mean_minutes") >= 0)
    return _rounded(exact_median(means, ["process_id"], "mean_minutes", "activity_minutes"))


def row_duration(log: DataFrame) -> DataFrame:
    """A3: row-level median of timestamp - start; of end - start where none is usable."""
    spans = log.filter(F.col("start_timestamp").isNotNull()).select(
        "process_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit("timestamp").alias("kind"),
                    minutes_between("start_timestamp", "timestamp").alias("minutes"),
                ),
                F.struct(
                    F.lit("end").alias("kind"),
                    minutes_between("start_timestamp", "end_timestamp").alias("minutes"),
                ),
            )
        ).alias("_s"),
    )
    usable = spans.select("process_id", "_s.*").filter(F.col("minutes") >= 0)
    both = exact_median(usable, ["process_id", "kind"], "minutes", "minutes")
    first = F.max(F.when(F.col("kind") == "timestamp", F.col("minutes")))
    second = F.max(F.when(F.col("kind") == "end", F.col("minutes")))
    return both.groupBy("process_id").agg(
        round_to(F.coalesce(first, second)).alias("row_minutes"),
        F.when(first.isNotNull(), F.lit("start-timestamp")).otherwise(F.lit("start-end")).alias("basis"),
    )


def case_spans(log: DataFrame) -> DataFrame:
    """First and last moment and event count of every case."""
    return log.groupBy(*CASE).agg(
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.count(F.lit(1)).alias("events"),
    )


def cycle_time(log: DataFrame) -> DataFrame:
    """A4: median over cases of last - first, in minutes."""
    cycles = case_spans(log).select(
        "process_id", minutes_between("first_ts", "last_ts").alias("_minutes")
    )
    return _rounded(exact_median(cycles, ["process_id"], "_minutes", "cycle_minutes"))


def case_waits(log: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Minutes since the previous event of the same case."""
    steps = along(_ordered(log), CASE, _ORDER, _SPLIT, lag={"_prev": "_at"}, max_rows=max_rows)
    return steps.select(
        *CASE,
        "activity",
        "timestamp",
        ((F.col("_at") - F.col("_prev")) / F.lit(60_000_000.0)).alias("wait_minutes"),
    )


def waiting_time(log: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """A5: median of the non-negative waits over all event pairs of all cases."""
    waits = case_waits(log, max_rows).filter(F.col("wait_minutes") >= 0)
    return _rounded(exact_median(waits, ["process_id"], "wait_minutes", "waiting_minutes"), "pairs")


def _rounded(medians: DataFrame, count: str | None = None) -> DataFrame:
    value = medians.columns[1]
    counted = [F.col("n").alias(count)] if count else []
    return medians.select("process_id", round_to(value).alias(value), *counted)


def directly_follows(log: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """How often one activity directly follows another within a case."""
    steps = along(
        _ordered(log), CASE, _ORDER, _SPLIT, lead={"next_activity": "activity"},
        max_rows=max_rows,
    )
    return (
        steps.filter(F.col("next_activity").isNotNull())
        .groupBy("process_id", "activity", "next_activity")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def case_ends(log: DataFrame) -> DataFrame:
    """Start and end activity of every case."""
    by = F.struct(*_ORDER)
    return _ordered(log).groupBy(*CASE).agg(
        F.min_by("activity", by).alias("start_activity"),
        F.max_by("activity", by).alias("end_activity"),
    )


def end_activity_counts(log: DataFrame) -> DataFrame:
    """Cases starting and ending with each activity."""
    sides = case_ends(log).select(
        "process_id",
        F.explode(
            F.array(
                F.struct(F.lit("start").alias("side"), F.col("start_activity").alias("activity")),
                F.struct(F.lit("end").alias("side"), F.col("end_activity").alias("activity")),
            )
        ).alias("_e"),
    )
    return sides.groupBy("process_id", F.col("_e.side").alias("side"), F.col("_e.activity").alias("activity")).agg(
        F.count(F.lit(1)).alias("cases")
    )


def _paths(log: DataFrame) -> DataFrame:
    """Ordered events of every case as one array; for cases of bounded length."""
    item = F.struct(*_ORDER)
    return _ordered(log).groupBy(*CASE).agg(F.sort_array(F.collect_list(item)).alias("_path"))


def _split_by_length(log: DataFrame, max_events: int) -> tuple[DataFrame, DataFrame | None]:
    """Events of short cases, and of long ones if there are any."""
    big = oversized(log, CASE, max_events)
    if big is None:
        return log, None
    marked = broadcast_if_small(big.select(*CASE))
    return log.join(marked, CASE, "left_anti"), log.join(marked, CASE)


def variants(log: DataFrame, max_events: int = MAX_PATH_EVENTS) -> DataFrame:
    """Distinct activity sequences with their case counts.

    ``variant`` lists the activities in order. Cases above ``max_events`` events are cut into pieces of
    that length, equal pieces get one name, and cases are compared by the names of their pieces, so
    equality is exact at any length. Their ``variant`` is null, as no row holds it: ``variant_parts``
    has the activities of every variant by ``example_case``.
    """
    short, long = _split_by_length(log, max_events)
    found = _path_variants(_paths(short))
    return found if long is None else found.unionByName(_long_variants(long, max_events))


def variant_parts(log: DataFrame, max_events: int = MAX_PATH_EVENTS) -> DataFrame:
    """(process_id, example_case, part, activities): every variant, ``max_events`` activities a row."""
    found = variants(log, max_events).select("process_id", F.col("example_case").alias("case_id"))
    named = log.join(broadcast_if_small(found), CASE, "left_semi")
    pieces = _pieces(along(_ordered(named), CASE, _ORDER, _SPLIT, position="_p"), "activity", max_events)
    return pieces.select("process_id", F.col("case_id").alias("example_case"), F.col("_c").alias("part"), F.col("_content").alias("activities"))


def _path_variants(paths: DataFrame) -> DataFrame:
    named_paths = paths.select(*CASE, F.col("_path.activity").alias("variant"))
    return named_paths.groupBy("process_id", "variant").agg(
        F.count(F.lit(1)).alias("cases"), F.min("case_id").alias("example_case")
    ).select(
        "process_id", "variant", F.size("variant").cast("long").alias("length"), "cases", "example_case"
    )


def _pieces(placed: DataFrame, value: str, length: int) -> DataFrame:
    """(case, _c, _content): ``value`` by position ``_p`` from 1, in pieces of ``length``."""
    piece = F.floor((F.col("_p") - 1) / length)
    content = F.transform(F.sort_array(F.collect_list(F.struct("_p", value))), lambda x: x[value])
    return placed.groupBy(*CASE, piece.alias("_c")).agg(content.alias("_content"))


def _long_variants(log: DataFrame, max_events: int, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    placed = along(_ordered(log), CASE, _ORDER, _SPLIT, position="_p", max_rows=max_rows)
    lengths = log.groupBy(*CASE).agg(F.count(F.lit(1)).alias("length"))
    placed, value = placed.select(*CASE, "_p", "activity"), "activity"
    while True:  # a round divides the length of the longest case by ``max_events``
        pieces = checkpoint(_pieces(placed, value, max_events))
        # A piece is named by the first case, and the place there, that has just its content.
        names = pieces.groupBy("process_id", "_content").agg(F.min(F.struct("case_id", "_c")).alias("_name"))
        named = pieces.join(names, ["process_id", "_content"]).select(*CASE, (F.col("_c") + 1).alias("_p"), F.to_json("_name").alias("_name"))
        placed, value = checkpoint(named), "_name"
        if placed.filter(F.col("_p") > 1).isEmpty():
            break
    whole = placed.select(*CASE, "_name").join(lengths, CASE)
    return whole.groupBy("process_id", "length", "_name").agg(
        F.count(F.lit(1)).alias("cases"), F.min("case_id").alias("example_case")
    ).select(
        "process_id",
        F.lit(None).cast("array<string>").alias("variant"),
        "length",
        "cases",
        "example_case",
    )


def variant_summary(log: DataFrame, max_events: int = MAX_PATH_EVENTS) -> DataFrame:
    """Number of variants and share of the most frequent one."""
    return _summary(variants(log, max_events))


def _summary(found: DataFrame) -> DataFrame:
    return found.groupBy("process_id").agg(
        F.count(F.lit(1)).alias("variants_count"),
        F.max("cases").alias("top_variant_cases"),
        round_to(F.max("cases") / F.sum("cases") * 100.0).alias("top_variant_share_pct"),
    )


def duration_summary(durations: DataFrame) -> DataFrame:
    """Median and total minutes and number of cases of a duration log."""
    totals = durations.groupBy("process_id").agg(
        F.coalesce(F.sum("duration_minutes"), F.lit(0.0)).alias("total_minutes"),
        F.countDistinct("case_id").alias("cases"),
        F.count(F.lit(1)).alias("rows"),
    )
    middle = exact_median(durations, ["process_id"], "duration_minutes", "median_minutes").drop("n")
    return totals.join(middle, "process_id", "left")


def _path_pairs(paths: DataFrame) -> DataFrame:
    """One row per event and its successor in the case."""
    places = F.when(F.size("_path") > 1, F.sequence(F.lit(1), F.size("_path") - 1))
    pair = F.transform(
        places,
        lambda i: F.struct(
            F.get("_path", i - 1)["activity"].alias("activity"),
            F.get("_path", i)["activity"].alias("next_activity"),
            ((F.get("_path", i)["_at"] - F.get("_path", i - 1)["_at"]) / F.lit(60_000_000.0)).alias("minutes"),
        ),
    )
    return paths.select("process_id", F.explode(pair).alias("_s")).select("process_id", "_s.*")


def process_measures(
    log: DataFrame, max_events: int = MAX_PATH_EVENTS, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """M7: activity, cycle and waiting medians, variant and edge counts per process.

    Cycles, waits, variants and edges all come from one exchange by case that gathers
    the case's path; only cases above ``max_events`` events are followed row by row. The
    three medians share one distributed pass keyed by (process, measure).
    """
    short, long = _split_by_length(log, max_events)
    paths = _paths(short)
    pairs = _path_pairs(paths)
    minutes = (F.element_at("_path", -1)["_at"] - F.get("_path", F.lit(0))["_at"]) / F.lit(60_000_000.0)
    cycles = paths.select("process_id", minutes.alias("minutes"))
    waits = pairs.select("process_id", "minutes")
    edges = pairs.select("process_id", "activity", "next_activity")
    found = _path_variants(paths)
    if long is not None:
        steps = along(
            _ordered(long), CASE, _ORDER, _SPLIT, lag={"_prev": "_at"},
            lead={"next_activity": "activity"}, max_rows=max_rows,
        )
        wait = ((F.col("_at") - F.col("_prev")) / F.lit(60_000_000.0)).alias("minutes")
        waits = waits.unionByName(steps.select("process_id", wait))
        edges = edges.unionByName(
            steps.filter(F.col("next_activity").isNotNull()).select("process_id", "activity", "next_activity")
        )
        cycles = cycles.unionByName(
            case_spans(long).select("process_id", minutes_between("first_ts", "last_ts").alias("minutes"))
        )
        found = found.unionByName(_long_variants(long, max_rows))

    activities = log.groupBy("process_id", "activity").agg(
        F.avg(minutes_between("start_timestamp", "timestamp")).alias("minutes"),
        F.max(F.col("start_timestamp").isNotNull()).alias("_started"),
    )
    samples = (
        activities.select("process_id", F.lit("activity").alias("measure"), "minutes")
        .unionByName(cycles.select("process_id", F.lit("cycle").alias("measure"), "minutes"))
        .unionByName(waits.select("process_id", F.lit("waiting").alias("measure"), "minutes"))
        .filter(F.col("minutes") >= 0)
    )
    medians = (
        exact_median(samples, ["process_id", "measure"], "minutes", "minutes")
        .groupBy("process_id")
        .agg(
            *[
                round_to(F.max(F.when(F.col("measure") == m, F.col("minutes")))).alias(f"{m}_minutes")
                for m in ("activity", "cycle", "waiting")
            ]
        )
    )
    edge_counts = edges.distinct().groupBy("process_id").agg(F.count(F.lit(1)).alias("dfg_edges_count"))
    started = activities.groupBy("process_id").agg(F.max("_started").alias("has_start"))
    return (
        started.join(medians, "process_id", "left")
        .join(_summary(found), "process_id", "left")
        .join(edge_counts, "process_id", "left")
        .withColumn("dfg_edges_count", F.coalesce("dfg_edges_count", F.lit(0)))
    )
