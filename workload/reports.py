"""Time report and savings queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import metrics as mt
from tracemill.operators import roi as r
from tracemill.operators import time_rules as tr
from workload import query
from workload.bindings import (
    CUSTOMER_METRICS,
    DURATIONS,
    LOG_ALL,
    customer_metrics,
    durations,
    log_all,
    r2,
    table,
)
from workload.mining import MEASURES, VOLUME


def flat(report: DataFrame) -> DataFrame:
    return mt.metric_rows(report).select(
        "process_id", "metric", "unit", F.round("value", 2).alias("value"), "confidence_level", "source"
    )


def _metric_sql(name: str, value: str, level: str, source: str, src: str) -> str:
    unit = mt.UNITS[name]
    return (
        f"select process_id, '{name}' metric, '{unit}' unit, round(cast({value} as double), 2) \"value\", "
        f"{level} confidence_level, {source} source from {src}"
    )


def _level(value: str, otherwise: str) -> str:
    return f"case when {value} is not null then 'provided' else {otherwise} end"


_OBS = "case when {v} is not null then 'observed' else 'missing' end"

# Process 'ship' brings its own volume, 'events' its manual time.
USER = """usr as (select 'ship' process_id, cast(count(*) as double) u_volume, cast(null as double) u_manual from supplier
  union all select 'events', null, cast(count(*) as double) from nation)"""


def user_values(spark, d) -> DataFrame:
    ship = table(spark, d, "supplier").agg(F.count("*").cast("double").alias("monthly_volume")).select(
        F.lit("ship").alias("process_id"), "monthly_volume", F.lit(None).cast("double").alias("manual_time_minutes")
    )
    events = table(spark, d, "nation").agg(F.count("*").cast("double").alias("manual_time_minutes")).select(
        F.lit("events").alias("process_id"), F.lit(None).cast("double").alias("monthly_volume"), "manual_time_minutes"
    )
    return ship.unionByName(events)


M8 = f"""log as ({LOG_ALL}), {VOLUME}, {MEASURES}, {USER},
base as (select process_id, {r2('cases / cast(days as double) * 30.0')} monthly, activity_minutes, cycle_minutes,
  waiting_minutes, u_volume, u_manual from vol left join act using (process_id) left join cyc using (process_id)
  left join wait using (process_id) left join usr using (process_id)),
m8 as ({_metric_sql('monthly_volume', 'coalesce(u_volume, monthly)', _level('u_volume', "'estimated'"), "case when u_volume is not null then 'user_input' else 'rule_engine' end", 'base')}
union all {_metric_sql('activity_duration_minutes', 'activity_minutes', _OBS.format(v='activity_minutes'), "'event_log'", 'base')}
union all {_metric_sql('case_cycle_time_minutes', 'cycle_minutes', _OBS.format(v='cycle_minutes'), "'event_log'", 'base')}
union all {_metric_sql('manual_time_minutes', 'coalesce(u_manual, activity_minutes)', _level('u_manual', "case when activity_minutes is not null then 'estimated' else 'missing' end"), "case when u_manual is not null then 'user_input' else 'rule_engine' end", 'base')}
union all {_metric_sql('waiting_time_minutes', 'waiting_minutes', _OBS.format(v='waiting_minutes'), "'event_log'", 'base')})"""


@query("m8_log_report", f"with {M8} select * from m8")
def m8(spark, d):
    return flat(mt.report_from_log(log_all(spark, d), user_values(spark, d)))


@query("m9_duration_report", f"""with dur as ({DURATIONS}), base as (select process_id, median(minutes) med,
  sum(minutes) total, count(distinct case_id) cases from dur group by 1)
{_metric_sql('monthly_volume', 'cases', "'estimated'", "'rule_engine'", 'base')}
union all {_metric_sql('activity_duration_minutes', 'med', "'estimated'", "'source_duration_column'", 'base')}
union all {_metric_sql('case_cycle_time_minutes', 'total', "'estimated'", "'source_duration_column'", 'base')}
union all {_metric_sql('manual_time_minutes', 'null', "'missing'", "'rule_engine'", 'base')}
union all {_metric_sql('waiting_time_minutes', 'null', "'missing'", "'rule_engine'", 'base')}""")
def m9(spark, d):
    return flat(mt.report_from_durations(durations(spark, d)))


_PROV = "case when {v} is not null then 'provided' else 'missing' end"
_EST = "case when {v} is not null then 'estimated' else 'missing' end"
M10 = f"""base as ({CUSTOMER_METRICS}),
m10 as ({_metric_sql('monthly_volume', 'volume', _PROV.format(v='volume'), "'user_input'", 'base')}
union all {_metric_sql('activity_duration_minutes', 'manual', _EST.format(v='manual'), "'rule_engine'", 'base')}
union all {_metric_sql('case_cycle_time_minutes', 'manual + waiting', _EST.format(v='(manual + waiting)'), "'rule_engine'", 'base')}
union all {_metric_sql('manual_time_minutes', 'manual', _PROV.format(v='manual'), "'user_input'", 'base')}
union all {_metric_sql('waiting_time_minutes', 'waiting', _PROV.format(v='waiting'), "'user_input'", 'base')})"""


def user_report(spark, d) -> DataFrame:
    return mt.report_from_user(customer_metrics(spark, d))


@query("m10_user_report", f"with {M10} select * from m10")
def m10(spark, d):
    return flat(user_report(spark, d))


@query("a12_precision", f"""with {M10}, n as (select process_id, {', '.join(
    f"count_if(confidence_level = '{lv}') {lv}_count" for lv in mt.LEVELS)} from m10 group by 1)
select *, case when missing_count > 0 then 'partial' when estimated_count > 0 then 'approximate' else 'precise' end "precision" from n""")
def a12(spark, d):
    out = mt.precision(user_report(spark, d))
    return out.select("process_id", *[F.col(f"{lv}_count") for lv in mt.LEVELS], "precision")


_FLAGS = """flags as (select process_id, volume, manual, waiting,
  volume is not null and manual is not null partial_ok from base)"""


@query("m5_roi_flags", f"""with {M10}, {_FLAGS} select process_id, false can_compute_full_roi,
partial_ok can_compute_partial_roi from flags""")
def m5(spark, d):
    return user_report(spark, d).select("process_id", "can_compute_full_roi", "can_compute_partial_roi")


def savings(spark, d) -> DataFrame:
    key = F.col("process_id").cast("long")
    return r.compute_roi(
        user_report(spark, d),
        F.when(key % 13 == 0, F.lit(0.0)).otherwise(F.lit(25.0)),
        F.when(key % 17 == 0, F.lit(1.2)).otherwise(F.lit(0.8)),
        F.lit(1.5),
        F.when(key % 2 == 0, F.lit(5000.0)),
    )


ROI = f"""{M10}, {_FLAGS}, par as (select *, cast(process_id as bigint) k,
    greatest(manual * 0.8 - 1.5, 0) saved from flags),
bad as (select *, case when k % 13 = 0 then 'hourly_rate_not_positive'
    when k % 17 = 0 then 'automation_rate_out_of_range' when not partial_ok then 'roi_blocked' end violation from par),
val as (select *, case when violation is null then volume * saved end as minutes from bad),
roi as (select process_id, k, {r2('minutes / 60')} heures_economisees_par_mois,
  {r2('minutes / 60 * 25')} economies_mensuelles, {r2('minutes / 60 * 25 * 12')} projection_annuelle,
  case when k % 2 = 0 and minutes > 0 then {r2('5000 / (minutes / 60 * 25)')} end mois_retour_investissement,
  case when partial_ok then 'partial' else 'blocked' end roi_mode, violation,
  case when violation is null then printf('%.2f cas/mois × %.2f min économisées/cas = %.2f min/mois = %.2f h/mois',
    volume, saved, minutes, minutes / 60) end detail_calcul,
  case when violation is null then 'automation_rate=0.80|residual_manual_time_minutes=1.50|taux_horaire=25.00'
    || case when k % 2 = 0 then '|implementation_cost=5000.00' else '' end else '' end assumptions from val)"""


@query("m11_savings", f"with {ROI} select process_id, heures_economisees_par_mois, economies_mensuelles, projection_annuelle, mois_retour_investissement, roi_mode, violation from roi")
def m11(spark, d):
    return savings(spark, d).select(
        "process_id", "heures_economisees_par_mois", "economies_mensuelles", "projection_annuelle",
        "mois_retour_investissement", F.col("confidence.roi_mode").alias("roi_mode"), "violation",
    )


@query("c11_c12_savings_texts", f"with {ROI} select process_id, assumptions, coalesce(detail_calcul, '') detail from roi")
def c11(spark, d):
    return savings(spark, d).select(
        "process_id", F.coalesce(F.array_join("assumptions", "|"), F.lit("")).alias("assumptions"),
        F.coalesce("detail_calcul", F.lit("")).alias("detail"),
    )


@query("v10_roi_violations", f"""with {ROI}, n as (
  select process_id, unnest(['heures_economisees_par_mois_invalid', 'economies_mensuelles_invalid',
    'projection_annuelle_invalid', 'detail_blank']) "rule" from roi where violation is not null
  union all select process_id, 'annual_not_12_months' from roi
    where abs(projection_annuelle - {r2('economies_mensuelles * 12')}) > 0.00001)
select process_id scope_id, 'roi' subject_kind, process_id subject_id, "rule" from n""")
def v10(spark, d):
    return r.roi_violations(savings(spark, d), tol=0.0)


BROKEN = f"""b as (select *, cast(process_id as bigint) k, manual is not null and waiting is not null present from ({CUSTOMER_METRICS})),
found as (select process_id, 'metric' subject_kind, 'manual_time_minutes' subject_id, 'missing_with_value' "rule" from b where k % 7 = 0 and manual is null
  union all select process_id, 'time_report', process_id, 'manual_above_cycle' from b where k % 7 = 0 and present
  union all select process_id, 'metric', 'waiting_time_minutes', case when waiting is null then 'missing_with_value' else 'value_negative' end from b where k % 7 <> 0 and k % 11 = 0
  union all select process_id, 'metric', 'monthly_volume', 'unit_unexpected' from b where k % 13 = 0
  union all select process_id, 'time_report', process_id, 'full_roi_flag_wrong' from b where k % 17 = 0
  union all select process_id, 'time_report', process_id, 'full_without_partial' from b where k % 17 = 0 and (volume is null or manual is null))"""


@query("v1_time_violations", f"""with {M8}, m as (select process_id,
  max(case when metric = 'manual_time_minutes' then "value" end) man, max(case when metric = 'activity_duration_minutes' then "value" end) act,
  max(case when metric = 'waiting_time_minutes' then "value" end) wai, max(case when metric = 'case_cycle_time_minutes' then "value" end) cyc,
  bool_or(metric <> 'monthly_volume' and confidence_level = 'missing') gap from m8 group by 1), {BROKEN}
select process_id scope_id, 'time_report' subject_kind, process_id subject_id, unnest(list_filter([
  case when man > cyc then 'manual_above_cycle' end, case when act > cyc then 'activity_above_cycle' end,
  case when wai > cyc then 'waiting_above_cycle' end], lambda x: x is not null)) "rule" from m where not gap
union all select process_id, subject_kind, subject_id, "rule" from found""")
def v1(spark, d):
    """Reports of all event logs, and those of customers, some of them broken in one of four ways."""
    k = F.col("process_id").cast("long")
    manual, waiting, volume = F.col("manual_time_minutes"), F.col("waiting_time_minutes"), F.col("monthly_volume")
    above = F.coalesce(F.col("case_cycle_time_minutes.value"), F.lit(0.0)) + 1
    report = user_report(spark, d).withColumns({
        "manual_time_minutes": F.when(k % 7 == 0, manual.withField("value", above)).otherwise(manual),
        "waiting_time_minutes": F.when((k % 7 != 0) & (k % 11 == 0), waiting.withField("value", F.lit(-1.0))).otherwise(waiting),
        "monthly_volume": F.when(k % 13 == 0, volume.withField("unit", F.lit("hours"))).otherwise(volume),
        "can_compute_full_roi": F.col("can_compute_full_roi") | (k % 17 == 0),
    })
    from_logs = mt.report_from_log(log_all(spark, d), user_values(spark, d))
    return tr.time_violations(from_logs).unionByName(tr.time_violations(report))


@query("v3_time_audit", f"""with {M10}, {_FLAGS} select process_id, array_to_string(list_filter([
  case when manual is not null then 'estimated_metrics' end,
  case when volume is null or manual is null or waiting is null then 'missing_metrics' end,
  case when partial_ok then 'partial_roi_only' end, case when not partial_ok then 'roi_disabled' end,
  case when waiting > manual * 3 then 'waiting_far_above_activity' end], lambda x: x is not null), '|') warnings from flags""")
def v3(spark, d):
    return tr.audit_time(user_report(spark, d)).select("process_id", F.array_join("warnings", "|").alias("warnings"))
