"""Operator inputs derived from the supplied tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.eventlog import duration_log, event_log
from tracemill.session import shuffled


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- event logs -------------------------------------------------------------

def log_events(spark: SparkSession, d: str) -> DataFrame:
    return event_log(
        table(spark, d, "events"), "user_id", "event_type", "ts", tiebreak="event_id", process="events"
    )


def log_day(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn(
        "case_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    )
    return event_log(ev, "case_id", "event_type", "ts", tiebreak="event_id", process="events_day")


def log_ship(spark: SparkSession, d: str) -> DataFrame:
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).withColumn(
        "activity", F.concat("l_returnflag", "l_linestatus")
    )
    return event_log(
        rows, "l_orderkey", "activity", "l_shipdate", start="o_orderdate",
        tiebreak="l_linenumber", process="ship",
    )


def log_all(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).unionByName(log_day(spark, d)).unionByName(log_ship(spark, d))


LOG_EVENTS = """select 'events' process_id, cast(user_id as varchar) case_id, event_type activity, ts,
  cast(null as timestamp) start_ts, event_id tie from events"""
LOG_DAY = """select 'events_day' process_id, user_id || '/' || strftime(ts, '%Y-%m-%d') case_id,
  event_type activity, ts, cast(null as timestamp) start_ts, event_id tie from events"""
LOG_SHIP = """select 'ship' process_id, cast(l_orderkey as varchar) case_id,
  l_returnflag || l_linestatus activity, l_shipdate ts, o_orderdate start_ts, l_linenumber tie
  from lineitem join orders on l_orderkey = o_orderkey"""
LOG_ALL = f"{LOG_EVENTS} union all {LOG_DAY} union all {LOG_SHIP}"


def r2(value: str, places: int = 2) -> str:
    """SQL rounding of the exact binary value, as the operators round."""
    return f"cast(printf('%.{places}f', cast({value} as double)) as double)"


def with_log(body: str, log: str = LOG_ALL) -> str:
    return f"with log as ({log}), {body}"


# ---- duration logs ----------------------------------------------------------

def durations(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return duration_log(ev, "user_id", "event_type", "value", process=F.col("event_type"))


DURATIONS = """select event_type process_id, cast(user_id as varchar) case_id, event_type activity,
  value as minutes from events where value is not null"""


# ---- user metrics -----------------------------------------------------------

def customer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One process per customer; every metric is absent for some of them."""
    c = table(spark, d, "customer")
    key, bal = F.col("c_custkey"), F.abs("c_acctbal")
    return c.select(
        key.cast("string").alias("process_id"),
        F.when(key % 5 != 0, F.floor(bal / 10)).cast("double").alias("monthly_volume"),
        F.when(key % 3 != 0, F.floor(bal / 25) / 4).cast("double").alias("manual_time_minutes"),
        F.when(key % 4 != 1, F.floor(bal / 7) / 2).cast("double").alias("waiting_time_minutes"),
    )


CUSTOMER_METRICS = """select cast(c_custkey as varchar) process_id,
  case when c_custkey % 5 <> 0 then floor(abs(c_acctbal) / 10) end volume,
  case when c_custkey % 3 <> 0 then floor(abs(c_acctbal) / 25) / 4 end manual,
  case when c_custkey % 4 <> 1 then floor(abs(c_acctbal) / 7) / 2 end waiting from customer"""


# ---- workflow graphs --------------------------------------------------------
# One workflow per user and day. The chain has a node per event and is acyclic; the
# follows graph has a node per event type and an edge per distinct direct succession.

_TYPES = {"signup": "trigger", "view": "automatique", "click": "humain", "error": "decision", "purchase": "fin"}


def _node_type(col: str):
    table_ = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    return F.try_element_at(table_, F.col(col))


_TYPE_SQL = "case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in _TYPES.items()) + " end"


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn(
        "workflow_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    )


def _next(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("workflow_id").orderBy("ts", "event_id")
    return _days(spark, d).select(
        "*", F.lead("event_id").over(w).alias("next_id"), F.lead("event_type").over(w).alias("next_type")
    )


DAYS = "select *, user_id || '/' || strftime(ts, '%Y-%m-%d') workflow_id from events"
NEXT = """select *, lead(event_id) over w next_id, lead(event_type) over w next_type from days
  window w as (partition by workflow_id order by ts, event_id)"""


def chain_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return _days(spark, d).select(
        "workflow_id",
        e.cast("string").alias("id"),
        F.when(e % 10 == 0, F.lit("one two three four five six")).otherwise(F.col("event_type")).alias("label"),
        _node_type("event_type").alias("type_noeud"),
        F.when(F.col("value") > 1, F.col("event_type")).otherwise(F.lit("  ")).alias("description"),
        F.when(e % 3 != 0, F.concat(F.lit("S"), (e % 7).cast("string"))).alias("etape_originale"),
        e.alias("ord"),
    )


def chain_edges(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d).filter(F.col("next_id").isNotNull()).select(
        "workflow_id",
        F.col("event_id").cast("string").alias("de"),
        F.col("next_id").cast("string").alias("vers"),
        F.when(F.col("value") > 50, F.lit("value > 50")).otherwise(F.lit(" ")).alias("condition"),
        F.col("event_id").alias("ord"),
    )


def chain_steps(spark: SparkSession, d: str) -> DataFrame:
    days = _days(spark, d).select("workflow_id").distinct()
    return days.select("workflow_id", F.explode(F.array(*[F.lit(f"S{i}") for i in range(5)])).alias("id"))


CHAIN = f"""days as ({DAYS}), nxt as ({NEXT}),
nodes as (select workflow_id, cast(event_id as varchar) id,
  case when event_id % 10 = 0 then 'one two three four five six' else event_type end label,
  {_TYPE_SQL.format(c='event_type')} type_noeud,
  case when value > 1 then event_type else '  ' end description,
  case when event_id % 3 <> 0 then 'S' || (event_id % 7) end etape_originale, event_id ord from days),
edges as (select workflow_id, cast(event_id as varchar) de, cast(next_id as varchar) vers,
  case when value > 50 then 'value > 50' else ' ' end "condition", event_id ord
  from nxt where next_id is not null),
steps as (select workflow_id, 'S' || i id from (select distinct workflow_id from days), range(5) r(i))"""


def follows_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _days(spark, d).groupBy("workflow_id", F.col("event_type").alias("id")).agg(
        F.min("event_id").alias("ord")
    ).select(
        "workflow_id", "id", F.col("id").alias("label"), _node_type("id").alias("type_noeud"),
        F.col("id").alias("description"), F.lit(None).cast("string").alias("etape_originale"), "ord",
    )


def follows_edges(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d).filter(F.col("next_type").isNotNull()).groupBy(
        "workflow_id", F.col("event_type").alias("de"), F.col("next_type").alias("vers")
    ).agg(F.min("event_id").alias("ord")).select(
        "workflow_id", "de", "vers", F.lit(None).cast("string").alias("condition"), "ord"
    )


FOLLOWS = f"""days as ({DAYS}), nxt as ({NEXT}),
nodes as (select workflow_id, event_type id, event_type label, {_TYPE_SQL.format(c='event_type')} type_noeud,
  event_type description, cast(null as varchar) etape_originale, min(event_id) ord from days group by 1, 2),
edges as (select workflow_id, event_type de, next_type vers, cast(null as varchar) "condition", min(event_id) ord
  from nxt where next_type is not null group by 1, 2, 3)"""


# ---- recommendations: one report per order ----------------------------------

def catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_size") > 25).select(
        F.concat(F.lit(" "), "p_name", F.lit("-"), F.pmod("p_partkey", F.lit(50)).cast("string")).alias("name")
    )


CATALOG = "select p_name || '-' || (p_partkey % 50) \"name\" from part where p_size > 25"


def advisor(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    orders, items, part = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    tool = F.concat("p_name", F.lit("-"), F.pmod("p_partkey", F.lit(50)).cast("string"))
    named = items.join(shuffled(part), items.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("workflow_id"),
        F.concat(F.lit("N"), F.col("l_linenumber").cast("string")).alias("noeud_id"),
        tool.alias("nom"),
        F.when(F.col("l_discount") > 0.01, F.col("l_returnflag")).alias("justification"),
        F.when(F.col("l_quantity") < 40, F.lit("faible")).otherwise(F.lit("expert")).alias("complexite"),
        F.when(F.col("l_quantity") > 5, F.lit("essentiel")).otherwise(F.lit("critique")).alias("priorite"),
        "l_linenumber", "l_quantity",
    )
    recs = named.filter(F.col("l_quantity") > 3).select(
        "workflow_id", "noeud_id",
        F.concat(F.lit("label "), F.pmod("l_linenumber", F.lit(6)).cast("string")).alias("noeud_label"),
    )
    reports = orders.select(
        F.col("o_orderkey").cast("string").alias("workflow_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat_ws(" ", "o_orderpriority", F.lit("first, then the rest")))
        .otherwise(F.lit("  ")).alias("conseil_implementation"),
    )
    nodes = reports.select(
        "workflow_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    ).select(
        "workflow_id",
        F.concat(F.lit("N"), F.col("i").cast("string")).alias("id"),
        F.concat(F.lit("label "), F.col("i").cast("string")).alias("label"),
        F.when(F.col("i") == 0, "trigger").when(F.col("i") == 4, "fin").otherwise("ia").alias("type_noeud"),
    )
    stacks = named.select(
        "workflow_id",
        F.when(F.col("l_linenumber") <= 2, F.lit("minimale")).otherwise(F.lit("complete")).alias("stack"),
        "nom",
    ).unionByName(named.filter(F.col("l_quantity") > 10).select("workflow_id", F.lit("complete").alias("stack"), "nom"))
    return {"reports": reports, "recs": recs, "tools": named.drop("l_linenumber", "l_quantity"), "nodes": nodes, "stacks": stacks}


ADVISOR = f"""catalog as (select distinct trim("name") "name" from ({CATALOG})),
named as (select cast(l_orderkey as varchar) workflow_id, 'N' || l_linenumber noeud_id,
  p_name || '-' || (p_partkey % 50) nom, case when l_discount > 0.01 then l_returnflag end justification,
  case when l_quantity < 40 then 'faible' else 'expert' end complexite,
  case when l_quantity > 5 then 'essentiel' else 'critique' end priorite, l_linenumber, l_quantity
  from lineitem join part on l_partkey = p_partkey),
recs as (select workflow_id, noeud_id, 'label ' || (l_linenumber % 6) noeud_label from named where l_quantity > 3),
reports as (select cast(o_orderkey as varchar) workflow_id,
  case when o_orderstatus <> 'P' then o_orderpriority || ' first, then the rest' else '  ' end advice from orders),
nodes as (select workflow_id, 'N' || i id, 'label ' || i label,
  case i when 0 then 'trigger' when 4 then 'fin' else 'ia' end type_noeud from reports, range(5) r(i)),
stacks as (select workflow_id, case when l_linenumber <= 2 then 'minimale' else 'complete' end stack, nom from named
  union all select workflow_id, 'complete', nom from named where l_quantity > 10)"""
