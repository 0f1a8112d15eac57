"""Process-mining queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import mining as m
from workload import query
from workload.bindings import (
    DURATIONS,
    LOG_DAY,
    LOG_EVENTS,
    durations,
    log_all,
    log_day,
    log_events,
    r2,
    with_log,
)

_MIN = "(epoch_us({b}) - epoch_us({a})) / 6e7"

VOLUME = """vol as (select process_id, count(distinct case_id) cases,
  greatest(cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) as bigint) + 1, 1) as days
  from log group by 1)"""
MEASURES = f"""ordered as (select *, lag(ts) over w prev, lead(activity) over w nxt from log
    window w as (partition by process_id, case_id order by ts, tie, activity)),
sojourn as (select process_id, activity, avg({_MIN.format(a='start_ts', b='ts')}) mean_minutes, count(*) events
    from log where start_ts is not null group by 1, 2),
act as (select process_id, {r2('median(mean_minutes)')} activity_minutes from sojourn
    where mean_minutes >= 0 group by 1),
spans as (select process_id, case_id, min(ts) first_ts, max(ts) last_ts, count(*) events from log group by 1, 2),
cyc as (select process_id, {r2('median(' + _MIN.format(a='first_ts', b='last_ts') + ')')} cycle_minutes
    from spans group by 1),
waits as (select process_id, case_id, activity, ts, {_MIN.format(a='prev', b='ts')} wait_minutes from ordered),
wait as (select process_id, {r2('median(wait_minutes)')} waiting_minutes, count(*) pairs from waits
    where wait_minutes >= 0 group by 1),
edge as (select process_id, activity, nxt next_activity, count(*) weight from ordered
    where nxt is not null group by 1, 2, 3),
paths as (select process_id, case_id, string_agg(activity, '>' order by ts, tie, activity) variant, count(*) length
    from log group by 1, 2),
variant as (select process_id, variant, max(length) length, count(*) cases, min(case_id) example_case
    from paths group by 1, 2),
vsum as (select process_id, count(*) variants_count, max(cases) top_variant_cases,
    {r2('max(cases) / cast(sum(cases) as double) * 100')} top_variant_share_pct from variant group by 1)"""


def flat_variants(v: DataFrame) -> DataFrame:
    return v.withColumn("variant", F.concat_ws(">", "variant"))


@query("a1_monthly_volume", with_log(VOLUME + f"""
select process_id, cases, days, {r2('cases / cast(days as double) * 30.0')} monthly_volume from vol"""))
def a1(spark, d):
    return m.monthly_volume(log_all(spark, d))


@query("a2_sojourn_by_activity", with_log(MEASURES + """
select process_id, activity, round(mean_minutes, 4) mean_minutes, events from sojourn"""))
def a2s(spark, d):
    return m.sojourn_by_activity(log_all(spark, d)).withColumn("mean_minutes", F.round("mean_minutes", 4))


@query("a2_activity_duration", with_log(MEASURES + " select * from act"))
def a2(spark, d):
    return m.activity_duration(log_all(spark, d))


@query("a3_row_duration", with_log(f"""x as (select process_id, (epoch_us(ts) - epoch_us(start_ts)) / 6e7 v from log
where start_ts is not null)
select process_id, {r2('median(v)')} row_minutes, 'start-timestamp' basis from x where v >= 0 group by 1"""))
def a3(spark, d):
    return m.row_duration(log_all(spark, d))


@query("a4_case_spans", with_log(MEASURES + " select * from spans"))
def a4s(spark, d):
    return m.case_spans(log_all(spark, d)).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")}
    )


@query("a4_cycle_time", with_log(MEASURES + " select * from cyc"))
def a4(spark, d):
    return m.cycle_time(log_all(spark, d))


@query("w1_case_waits", with_log(MEASURES + """
select process_id, case_id, activity, round(wait_minutes, 4) wait_minutes from waits""", LOG_EVENTS))
def w1(spark, d):
    return m.case_waits(log_events(spark, d)).select(
        "process_id", "case_id", "activity", F.round("wait_minutes", 4).alias("wait_minutes")
    )


@query("a5_waiting_time", with_log(MEASURES + " select * from wait"))
def a5(spark, d):
    return m.waiting_time(log_all(spark, d))


@query("a6_variants", with_log(MEASURES + " select * from variant", LOG_DAY))
def a6(spark, d):
    return flat_variants(m.variants(log_day(spark, d)))


@query("a6_variant_summary", with_log(MEASURES + " select * from vsum"))
def a6s(spark, d):
    return m.variant_summary(log_all(spark, d))


@query("o3_top_variants", with_log(MEASURES + """
select variant, cases from variant order by cases desc, variant limit 10""", LOG_DAY))
def o3(spark, d):
    return flat_variants(m.variants(log_day(spark, d))).select("variant", "cases").orderBy(
        F.desc("cases"), "variant"
    ).limit(10)


@query("a7_directly_follows", with_log(MEASURES + " select * from edge"))
def a7(spark, d):
    return m.directly_follows(log_all(spark, d))


@query("a7_end_activities", with_log("""x as (select process_id, case_id,
    arg_min(activity, row(ts, tie, activity)) s, arg_max(activity, row(ts, tie, activity)) e from log group by 1, 2)
select process_id, side, activity, count(*) cases from (
    select process_id, 'start' side, s activity from x union all select process_id, 'end', e from x) group by 1, 2, 3"""))
def a7e(spark, d):
    return m.end_activity_counts(log_all(spark, d))


@query("w2_case_ends", with_log("""x as (select *, row_number() over w n, row_number() over r k from log
  window w as (partition by process_id, case_id order by ts, tie, activity),
         r as (partition by process_id, case_id order by ts desc, tie desc, activity desc))
select process_id, case_id, max(case when n = 1 then activity end) start_activity,
  max(case when k = 1 then activity end) end_activity from x group by 1, 2""", LOG_DAY))
def w2(spark, d):
    return m.case_ends(log_day(spark, d))


@query("a8_duration_summary", f"""with dur as ({DURATIONS})
select process_id, round(sum(minutes), 2) total_minutes, count(distinct case_id) cases, count(*) "rows",
  median(minutes) median_minutes from dur group by 1""")
def a8(spark, d):
    return m.duration_summary(durations(spark, d)).withColumn("total_minutes", F.round("total_minutes", 2))


@query("m7_process_measures", with_log(MEASURES + """,
has as (select process_id, bool_or(start_ts is not null) has_start from log group by 1),
edges as (select process_id, count(*) dfg_edges_count from edge group by 1)
select process_id, has_start, activity_minutes, cycle_minutes, waiting_minutes, variants_count,
  top_variant_cases, top_variant_share_pct, coalesce(dfg_edges_count, 0) dfg_edges_count
from has left join act using (process_id) left join cyc using (process_id) left join wait using (process_id)
left join vsum using (process_id) left join edges using (process_id)"""))
def m7(spark, d):
    return m.process_measures(log_all(spark, d))
