"""Source, normalisation, resolution and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars as s
from tracemill.functions.times import time_forms
from tracemill.operators.actions import GREETINGS, atomic_actions
from tracemill.operators.normalize import normalize
from tracemill.operators.resolve import resolve_time_context
from tracemill.operators.rules import union_all
from tracemill.operators.telemetry import telemetry_summary
from tracemill.sources.catalog import catalog_names
from tracemill.sources.documents import documents_without_records, extract_records, records_table
from tracemill.sources.exports import export_documents
from tracemill.session import shuffle_parts, shuffled
from workload import query
from workload.bindings import CATALOG, catalog, log_all, r2, table, with_log


def documents(spark, d) -> DataFrame:
    """One JSON document per event; the shape changes with the event id."""
    ev = table(spark, d, "events")
    record = F.to_json(F.struct("event_type", "value"))
    doc = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), record, F.lit(","), F.col("props"), F.lit("]")))
        .when(
            F.col("event_id") % 4 == 1,
            F.concat(
                F.lit('{"source":"x","tags":["a","b"],"none":[],"z.rows":['), record, F.lit("],\"a\":["),
                F.col("props"), F.lit("]}"),
            ),
        )
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"meta":'), F.col("props"), F.lit(',"note":"[{"}')))
        .otherwise(F.concat(F.lit('{"rows":['), F.col("props"), F.lit("]}")))
    )
    return ev.select("event_id", doc.alias("document"))


DOCUMENTS = """docs as (
  select event_id, 0 record_no, event_type, value, cast(null as bigint) k from events where event_id % 4 in (0, 1)
  union all select event_id, case event_id % 4 when 0 then 1 else 0 end, null, null,
    cast(json_extract(props, '$.k') as bigint) from events where event_id % 4 in (0, 3))"""


@query("s2_extract_records", f"with {DOCUMENTS} select event_id, cast(record_no as integer) record_no from docs")
def s2(spark, d):
    return extract_records(documents(spark, d)).select("event_id", "record_no")


@query("s3_records_table", f"""with {DOCUMENTS}
select event_id, cast(record_no as integer) record_no, event_type, value, k from docs""")
def s3(spark, d):
    return records_table(extract_records(documents(spark, d))).select(
        "event_id", "record_no", "event_type", "value", "k"
    )


AWKWARD = """select event_id, event_type "VARIANT", user_id "VOID", case when event_id % 3 = 0 then value end "a.b",
  event_type "Name", event_id "name_2", cast(case when event_id % 2 = 0 then 10000000000000000000000 + event_id else event_id end as varchar) big_text
from events"""


@query("s3_awkward_names", AWKWARD)
def s3_awkward(spark, d):
    """Field names that are type words, hold a dot or differ in case only; whole numbers of 23 digits."""
    big = F.when(F.col("event_id") % 2 == 0, F.lit("10000000000000000000000").cast("decimal(25,0)") + F.col("event_id")).otherwise(F.col("event_id"))
    ev = table(spark, d, "events").withColumn("big", big.cast("decimal(25,0)"))
    fields = F.array(
        F.concat(F.lit('"VARIANT":"'), "event_type", F.lit('"')), F.concat(F.lit('"VOID":'), F.col("user_id").cast("string")),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"a.b":'), F.get_json_object(F.to_json(F.struct("value")), "$.value"))),
        F.concat(F.lit('"Name":"'), "event_type", F.lit('"')), F.concat(F.lit('"name":'), F.col("event_id").cast("string")),
        F.concat(F.lit('"big":'), F.col("big").cast("string")),
    )
    records = ev.select("event_id", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("record"))
    out = records_table(records)
    return out.select("event_id", "VARIANT", "VOID", "`a.b`", "Name", "name_2", F.col("big").cast("string").alias("big_text"))


@query("s5_documents_without_records", "select event_id from events where event_id % 4 = 2")
def s5(spark, d):
    return documents_without_records(documents(spark, d))


@query("s7_catalog_names", f'select distinct trim("name") "name" from ({CATALOG})')
def s7(spark, d):
    return catalog_names(catalog(spark, d))


@query("s8_export_documents", """select c_custkey, c_mktsegment title, o.n orders, o.top top
from customer left join (select o_custkey, count(*) n, max(o_totalprice) top from orders group by 1) o
on c_custkey = o_custkey""")
def s8(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("top")
    )
    docs = export_documents(
        c.select("c_custkey", "c_mktsegment"), per.select("c_custkey", "n"), per.select("c_custkey", "top"),
        "c_custkey",
    )
    get = F.get_json_object
    return docs.select(
        "c_custkey",
        get("document", "$.diagnosis.c_mktsegment").alias("title"),
        get("document", "$.workflow.n").cast("long").alias("orders"),
        get("document", "$.recommendations.top").cast("double").alias("top"),
    )


def exports(spark, d) -> DataFrame:
    """Events as an export with text timestamps, some blank, and a text duration."""
    e = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    end = F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + F.floor("value")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select(
        e,
        F.when(e % 11 != 0, F.col("event_type")).alias("action"),
        F.when(e % 5 != 0, stamp).otherwise(F.lit("unknown")).alias("created"),
        F.when(e % 3 != 0, end).alias("resolved"),
        F.when(e % 4 != 0, F.col("value").cast("string")).otherwise(F.lit("n/a")).alias("resolution_time_hours"),
    )


EXPORTS = """exp as (select event_id, case when event_id % 11 <> 0 then event_type end content,
  case when event_id % 5 <> 0 and event_id % 3 <> 0 then cast(floor(value) as double) / 60 end span,
  case when event_id % 4 <> 0 then value end stated from events)"""


@query("p7_normalize_convert", f"""with {EXPORTS} select event_id, content,
round(coalesce(span, stated * 60), 6) duration_minutes from exp where content is not null""")
def p7(spark, d):
    return normalize(exports(spark, d)).select(
        "event_id", "content", F.round("duration_minutes", 6).alias("duration_minutes")
    )


@query("p7_normalize_raw", f"""with {EXPORTS} select event_id, content,
round(coalesce(span, stated), 6) duration_minutes from exp where content is not null""")
def p7r(spark, d):
    return normalize(exports(spark, d), units="raw").select(
        "event_id", "content", F.round("duration_minutes", 6).alias("duration_minutes")
    )


@query("p10_resolve_timestamps", """select cast(user_id as varchar) case_id, event_type activity, ts "timestamp",
case when event_id % 2 = 0 then ts end start_timestamp, event_id from events""")
def p10(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("Ticket_ID"), F.col("event_type").alias("EVENT"),
        F.col("ts").alias("Created_At"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("started_at"),
    )
    out, _ = resolve_time_context(ev)
    return out.select(F.col("case_id").cast("string").alias("case_id"), "activity", "timestamp", "start_timestamp", "event_id")


def _resolve_duration(name: str, factor: float, with_case: bool):
    case = "cast(user_id as varchar)" if with_case else "'global_case_1'"

    @query(f"p11_13_resolve_{name}", f"""select event_id, {case} case_id, event_type activity,
round(value * {factor}, 6) duration_minutes from events""")
    def run(spark, d):
        ev = table(spark, d, "events").withColumn(name, F.col("value").cast("string"))
        kept = ["event_id", "event_type", name, *(["user_id"] if with_case else [])]
        renamed = ev.select(*kept).withColumnsRenamed({"event_type": "step", "user_id": "client_id"})
        out, _ = resolve_time_context(renamed)
        return out.select(
            "event_id", F.col("case_id").cast("string").alias("case_id"), "activity",
            F.round("duration_minutes", 6).alias("duration_minutes"),
        )


_resolve_duration("duree_minutes", 1.0, True)
_resolve_duration("duration_hours", 60.0, False)
_resolve_duration("duree_jours", 1440.0, True)


@query("p9_p17_time_contexts", """select variant, resolution, "mode", report, quantified, n,
  case when variant = 'no_activity' then 0 else distinct_types end activities from (values
  ('no_activity', 'none', 'insufficient', 'none', false), ('user_metrics', 'E', 'provided', 'user_input', true),
  ('one_user_metric', 'F', 'insufficient', 'none', false), ('no_time', 'F', 'insufficient', 'none', false),
  ('minutes', 'B', 'estimated', 'duration_column', true), ('moments', 'A', 'estimated', 'event_log', true)
) v(variant, resolution, "mode", report, quantified) join (select count(*) n, count(distinct event_type) distinct_types from events) e on true""")
def p9_p17(spark, d):
    """What the resolver makes of the events with some columns left out, beside what it keeps of them."""
    ev = table(spark, d, "events").select("event_id", "value", F.col("event_type").alias("step"), "ts")
    both = {"monthly_volume": 3.0, "manual_time_minutes": 4.0}
    given = {
        "no_activity": (ev.select("event_id", "value"), None), "user_metrics": (ev.select("event_id", "step"), both),
        "one_user_metric": (ev.select("event_id", "step"), {"monthly_volume": 3.0}), "no_time": (ev.select("event_id", "step"), None),
        "minutes": (ev.select("event_id", "step", F.col("value").alias("duree_minutes")), None), "moments": (ev, None),
    }
    rows = []
    for name, (df, metrics) in given.items():
        out, context = resolve_time_context(df.withColumn("kept", F.lit(1)), metrics)
        activity = F.col("activity") if "activity" in out.columns else F.lit(None)
        counts = out.agg(F.count("kept").alias("n"), F.countDistinct(activity).alias("_a"))
        told = {"variant": name, "resolution": context.case, "mode": context.mode, "report": context.report_path(), "quantified": context.can_run_time_quantification}
        rows.append(counts.select(*[F.lit(v).alias(c) for c, v in told.items()], "n", F.col("_a").alias("activities")))
    return union_all(rows)


@query("p19_coerce_timestamps", """select event_id, case when event_id % 5 <> 0 then date_trunc('second', ts) end parsed
from events""")
def p19(spark, d):
    ex = exports(spark, d)
    return ex.select(
        "event_id", s.as_timestamp("created", ex.schema["created"].dataType).cast("timestamp_ntz").alias("parsed")
    )


FORMS = ("yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "MMM d, yyyy HH:mm", "d MMMM yyyy HH:mm", "yyyyMMdd HHmm'00'", "d-MMM-yyyy hh:mm a")


@query("p6_timestamp_forms", """select event_id, date_trunc('minute', ts) by_day, date_trunc('minute', ts) by_month,
date_trunc('minute', ts) named, case when event_id % 7 <> 0 then date_trunc('day', ts) end holes from events""")
def p6_forms(spark, d):
    """The same moments day first, month first, in forms with one reading, and as bare days with some words among them."""
    ev = table(spark, d, "events")
    mixed = F.coalesce(*[F.when(F.col("event_id") % len(FORMS) == i, F.date_format("ts", f)) for i, f in enumerate(FORMS)])
    written = ev.select(
        "event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("by_day"), F.date_format("ts", "M/d/yy h:mm a").alias("by_month"),
        mixed.alias("named"), F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "d.M.yyyy")).otherwise("open").alias("holes"),
    )
    forms = time_forms(written, ["by_day", "by_month", "named", "holes"])
    return written.select("event_id", *[s.as_timestamp(c, written.schema[c].dataType, forms[c].day_first).cast("timestamp_ntz").alias(c) for c in written.columns[1:]])


_GREET = "|".join(GREETINGS)


@query("p20_atomic_actions", rf"""with p as (select conv_id, turn, role, unnest(string_split(
    regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '(\r?\n)+', chr(10), 'g'), chr(10))) piece,
  from conversations),
q as (select *, trim(piece, ' ' || chr(9) || chr(13)) line from p),
r as (select *, trim(regexp_replace(line, '^\[?(\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}})?)?)\]?', '')) rest from q),
t as (select *, regexp_extract(rest, '^([\p{{L}}][\p{{L}}\p{{N}} ._-]{{0,40}}?)\s*:\s+', 1) who,
  trim(regexp_replace(rest, '^([\p{{L}}][\p{{L}}\p{{N}} ._-]{{0,40}}?)\s*:\s+', '')) body from r)
select conv_id, turn, body "action", case when who = '' then role else who end acteur, count(*) copies from t
where body <> '' and not regexp_matches(lower(body), '^(?:{_GREET})\b[\s,.!?]*$') group by 1, 2, 3, 4""")
def p20(spark, d):
    rows = atomic_actions(table(spark, d, "conversations"), "text", "role", ["conv_id", "turn"])
    return rows.groupBy("conv_id", "turn", "action", "acteur").agg(F.count("*").alias("copies"))


# ---- scalar functions -------------------------------------------------------

@query("c1_parse_percent", """select l_orderkey, l_linenumber, case when l_quantity * 2.5 between 0 and 100
and l_linenumber % 7 <> 0 then l_quantity * 2.5 end share, count(*) n from lineitem group by 1, 2, 3""")
def c1(spark, d):
    text = F.when(
        F.col("l_linenumber") % 7 != 0, F.concat(F.lit(" "), (F.col("l_quantity") * 2.5).cast("string"), F.lit(" % "))
    ).otherwise(F.lit("much"))
    return table(spark, d, "lineitem").groupBy(
        "l_orderkey", "l_linenumber", s.parse_percent(text).alias("share")
    ).agg(F.count("*").alias("n"))


@query("c2_sanitize_id", "select p_partkey, regexp_replace(lower(p_brand || '-' || p_name), '[^a-z0-9_]', '_', 'g') clean from part")
def c2(spark, d):
    return table(spark, d, "part").select("p_partkey", s.sanitize_id(F.concat("p_brand", F.lit("-"), "p_name")).alias("clean"))


@query("c3_short_label", "select doc_id, case when length(text) > 40 then left(text, 38) || '..' else text end label from documents")
def c3(spark, d):
    return table(spark, d, "documents").select("doc_id", s.short_label("text").alias("label"))


@query("c5_word_count", r"select doc_id, len(regexp_extract_all(text, '[^\s\p{Z}]+')) words from documents")
def c5(spark, d):
    return table(spark, d, "documents").select("doc_id", s.word_count("text").cast("long").alias("words"))


@query("c7_whole_days", """select l_orderkey, l_linenumber, cast(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0) as bigint) as days,
count(*) n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3""")
def c7(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    # Both sides in partitions by their number of rows, as one shuffle serves the join and the groups.
    parts = shuffle_parts(spark, items.count())
    dealt = items.select("l_orderkey", "l_linenumber", "l_shipdate").repartition(parts, "l_orderkey")
    rows = dealt.join(shuffled(orders.select("o_orderkey", "o_orderdate").repartition(parts, "o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    days = s.whole_days_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    return rows.groupBy("l_orderkey", "l_linenumber", days.alias("days")).agg(F.count("*").alias("n"))


@query("c9_min_cluster_size", with_log("""n as (select process_id, activity, count(*) n from log group by 1, 2)
select process_id, activity, n, cast(greatest(2, floor(1.5 * ln(n))) as integer) size from n"""))
def c9(spark, d):
    sizes = log_all(spark, d).groupBy("process_id", "activity").agg(F.count("*").alias("n"))
    return sizes.withColumn("size", s.min_cluster_size("n"))


@query("c14_typed_label", "select p_partkey, p_name || chr(10) || '[' || upper(p_type) || ']' label from part")
def c14(spark, d):
    return table(spark, d, "part").select("p_partkey", s.typed_label("p_name", "p_type").alias("label"))


@query("a18_telemetry", f"""select l_orderkey run_id, {r2('sum(' + r2('l_quantity / 7', 3) + ')', 3)} total_latency_seconds,
cast(sum(case when l_linenumber % 3 <> 0 then l_partkey else 0 end) as bigint) total_prompt_tokens,
cast(sum(l_suppkey) as bigint) total_completion_tokens,
cast(sum(case when l_linenumber % 3 <> 0 then l_partkey else 0 end) + sum(l_suppkey) as bigint) total_tokens
from lineitem group by 1""")
def a18(spark, d):
    usage = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("agent_name"),
        (F.col("l_quantity") / 7).alias("latency_seconds"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey")).alias("prompt_tokens"),
        F.col("l_suppkey").alias("completion_tokens"),
    )
    return telemetry_summary(usage)
