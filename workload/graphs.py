"""Workflow graph and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import graph as g
from tracemill.operators import transform as t
from tracemill.operators import workflow_rules as wr
from workload import query
from workload.bindings import (
    CHAIN,
    DAYS,
    FOLLOWS,
    chain_edges,
    chain_nodes,
    chain_steps,
    follows_edges,
    follows_nodes,
    table,
)

_DEG = """deg as (select n.workflow_id, n.id, n.type_noeud, n.label, n.description, n.etape_originale,
  (select count(*) from edges e where e.workflow_id = n.workflow_id and e.vers = n.id) indegree,
  (select count(*) from edges e where e.workflow_id = n.workflow_id and e.de = n.id) outdegree,
  (select count(*) from edges e where e.workflow_id = n.workflow_id and e.de = n.id and trim("condition") <> '') conditioned
  from nodes n)"""
_WALK = """walk(workflow_id, a, b) as (select workflow_id, de, vers from edges
  union select w.workflow_id, w.a, e.vers from walk w join edges e on w.workflow_id = e.workflow_id and w.b = e.de)"""
_SEEN = """seen as (select workflow_id, id from nodes where type_noeud = 'trigger'
  union select w.workflow_id, w.b from walk w join nodes n on n.workflow_id = w.workflow_id and n.id = w.a
  where n.type_noeud = 'trigger')"""


@query("a16_degrees", f"with {CHAIN}, {_DEG} select workflow_id, id, indegree, outdegree, conditioned from deg")
def a16(spark, d):
    return g.degrees(chain_nodes(spark, d), chain_edges(spark, d)).select(
        "workflow_id", "id", "indegree", "outdegree", "conditioned"
    )


@query("g1_self_loops", f"with {FOLLOWS} select workflow_id, de from edges where de = vers")
def g1(spark, d):
    return g.self_loops(follows_edges(spark, d)).select("workflow_id", "de")


@query("j2_unknown_endpoints", f"""with {FOLLOWS}, known as (select workflow_id, id from nodes where type_noeud <> 'decision')
select workflow_id, de, vers, side, id from (select workflow_id, de, vers, 'de' side, de id from edges
  union all select workflow_id, de, vers, 'vers', vers from edges) e
where not exists (select 1 from known k where k.workflow_id = e.workflow_id and k.id = e.id)""")
def j2(spark, d):
    known = follows_nodes(spark, d).filter(F.col("type_noeud") != "decision")
    return g.unknown_endpoints(known, follows_edges(spark, d)).select("workflow_id", "de", "vers", "side", "id")


@query("g2_cyclic_workflows", f"with recursive {FOLLOWS}, {_WALK} select distinct workflow_id from walk where a = b")
def g2(spark, d):
    return g.cyclic_workflows(follows_edges(spark, d))


@query("g2_chain_is_acyclic", f"""with days as ({DAYS})
select workflow_id from days where user_id % 3 = 0 group by 1 having count(*) > 1""")
def g2c(spark, d):
    """Chains, of which those of every third user are closed from their last event to the first."""
    moment = F.struct("ts", "event_id")
    ends = table(spark, d, "events").filter(F.col("user_id") % 3 == 0).groupBy(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("workflow_id")
    ).agg(F.max(moment).alias("_last"), F.min(moment).alias("_first"), F.count(F.lit(1)).alias("_n"))
    closing = ends.filter("_n > 1").select(
        "workflow_id", F.col("_last.event_id").cast("string").alias("de"), F.col("_first.event_id").cast("string").alias("vers")
    )
    return g.cyclic_workflows(chain_edges(spark, d).select("workflow_id", "de", "vers").unionByName(closing))


@query("g4_reachable", f"with recursive {FOLLOWS}, {_WALK}, {_SEEN} select workflow_id, id from seen")
def g4(spark, d):
    nodes = follows_nodes(spark, d)
    return g.reachable(follows_edges(spark, d), nodes.filter(F.col("type_noeud") == "trigger"))


@query("g4_unreachable_ends", f"""with recursive {FOLLOWS}, {_WALK}, {_SEEN}
select workflow_id, id from nodes where type_noeud = 'fin' except select workflow_id, id from seen""")
def g4u(spark, d):
    return g.unreachable_ends(follows_nodes(spark, d), follows_edges(spark, d))


@query("g4_workflows_without_path", f"""with recursive {FOLLOWS}, {_WALK}, {_SEEN}
select distinct workflow_id from nodes except select workflow_id from seen join nodes using (workflow_id, id)
where type_noeud = 'fin'""")
def g4w(spark, d):
    return g.workflows_without_path(follows_nodes(spark, d), follows_edges(spark, d))


_REPAIR = """kind as (select workflow_id, count_if(type_noeud = 'trigger') triggers, count_if(type_noeud = 'fin') fins,
  arg_min(id, ord) first_id, arg_min(id, ord) filter (type_noeud = 'fin') fin_id, max(ord) last from nodes group by 1),
new_nodes as (select workflow_id, 'trigger_1' id, 'trigger' type_noeud from kind where triggers = 0
  union all select workflow_id, 'fin_1', 'fin' from kind where fins = 0),
roots as (select workflow_id, id from nodes n where not exists
  (select 1 from edges e where e.workflow_id = n.workflow_id and e.vers = n.id)),
entry as (select * from roots union all select workflow_id, first_id from kind
  where workflow_id not in (select workflow_id from roots)),
new_edges as (select workflow_id, 'trigger_1' de, id vers from entry join kind using (workflow_id) where triggers = 0
  union all select n.workflow_id, n.id, coalesce(k.fin_id, 'fin_1') from nodes n join kind k using (workflow_id)
  where n.type_noeud <> 'fin' and not exists
    (select 1 from edges e where e.workflow_id = n.workflow_id and e.de = n.id))"""


@query("g6_repaired_nodes", f"""with {FOLLOWS}, {_REPAIR} select workflow_id, id, type_noeud from nodes
union all select * from new_nodes""")
def g6n(spark, d):
    nodes, _ = g.ensure_boundaries(follows_nodes(spark, d), follows_edges(spark, d))
    return nodes.select("workflow_id", "id", "type_noeud")


@query("g6_repaired_edges", f"""with {FOLLOWS}, {_REPAIR} select workflow_id, de, vers from edges
union all select * from new_edges""")
def g6e(spark, d):
    _, edges = g.ensure_boundaries(follows_nodes(spark, d), follows_edges(spark, d))
    return edges.select("workflow_id", "de", "vers")


@query("g7_free_ids", """with used as (select distinct o_custkey w, o_orderkey % 4 + 1 i from orders),
cand as (select distinct o_custkey w, 1 i from orders union select w, i + 1 from used)
select cast(w as varchar) workflow_id, 'node_' || min(i) id from cand c
where not exists (select 1 from used u where u.w = c.w and u.i = c.i) group by 1""")
def g7(spark, d):
    o = table(spark, d, "orders")
    nodes = o.select(
        F.col("o_custkey").cast("string").alias("workflow_id"),
        F.concat(F.lit("node_"), (F.col("o_orderkey") % 4 + 1).cast("string")).alias("id"),
    )
    return g.unique_node_id(nodes, nodes.select("workflow_id").distinct(), "node")


_CLASSES = """touched as (select workflow_id, etape_originale step_id, bool_or(type_noeud = 'humain') h,
  bool_or(type_noeud in ('automatique', 'trigger')) a from nodes where etape_originale <> '' group by 1, 2),
classes as (select coalesce(s.workflow_id, x.workflow_id) workflow_id, coalesce(s.id, x.step_id) step_id,
  case when h then 'human' when a then 'automated' else 'eliminated' end "class"
  from steps s full join (select * from touched where h or a) x on s.workflow_id = x.workflow_id and s.id = x.step_id)"""


def classes(spark, d):
    return t.classify_steps(chain_steps(spark, d), chain_nodes(spark, d))


@query("u1_classify_steps", f"with {CHAIN}, {_CLASSES} select * from classes")
def u1(spark, d):
    return classes(spark, d)


@query("u1_transformation_lists", f"""with {CHAIN}, {_CLASSES} select workflow_id, {', '.join(
    f"count_if(class = '{c}') {c}_count, coalesce(string_agg(case when class = '{c}' then step_id end, '|' order by step_id), '') {c}"
    for c in t.CLASSES)} from classes group by 1""")
def u1l(spark, d):
    lists = t.transformation_lists(classes(spark, d))
    return lists.withColumns({c: F.array_join(c, "|") for c in t.CLASSES})


@query("u2_uncovered_steps", f"""with {CHAIN}, {_CLASSES} select workflow_id, step_id, 'unknown_step' side from classes c
where not exists (select 1 from steps s where s.workflow_id = c.workflow_id and s.id = c.step_id)""")
def u2(spark, d):
    return t.uncovered_steps(classes(spark, d), chain_steps(spark, d))


@query("u3_overlapping_classes", """with c as (select l_orderkey workflow_id, 'S' || l_linenumber step_id, l_returnflag "class" from lineitem)
select workflow_id, step_id, count(distinct "class") classes from c group by 1, 2 having count(distinct "class") > 1""")
def u3(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("workflow_id"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("step_id"),
        F.col("l_returnflag").alias("class"),
    )
    return t.overlapping_classes(rows)


@query("u5_empty_transformations", """select c_custkey workflow_id from customer left join orders
on o_custkey = c_custkey group by 1 having count(o_orderkey) = 0""")
def u5(spark, d):
    """Customers as workflows, all their orders as classified steps."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("workflow_id"))
    return t.empty_transformations(orders, table(spark, d, "customer").select(F.col("c_custkey").alias("workflow_id")))


_OPERATOR = "case type_noeud " + " ".join(f"when '{k}' then '{v}'" for k, v in t.TASK_OPERATORS.items()) + " end"


@query("c13_tasks", f"""with {CHAIN} select workflow_id, 'task_' || id task_id, {_OPERATOR} operator from nodes""")
def c13(spark, d):
    return t.tasks(chain_nodes(spark, d)).select("workflow_id", "task_id", "operator")


@query("c13_dependencies", f"with {CHAIN} select workflow_id, 'task_' || de || ' >> task_' || vers dependency from edges")
def c13d(spark, d):
    return t.dependencies(chain_edges(spark, d))


@query("a13_type_counts", f"""with {CHAIN} select workflow_id, count(*) nodes, {', '.join(
    f"count_if(type_noeud = '{k}') {k}_count" for k in wr.NODE_TYPES)} from nodes group by 1""")
def a13(spark, d):
    return wr.type_counts(chain_nodes(spark, d))


_NODE_RULES = {
    "description_blank": "trim(description) = ''",
    "label_too_long": "label like '% % % % % %'",
    "trigger_with_input": "type_noeud = 'trigger' and indegree > 0",
    "trigger_without_output": "type_noeud = 'trigger' and outdegree = 0",
    "end_with_output": "type_noeud = 'fin' and outdegree > 0",
    "end_without_input": "type_noeud = 'fin' and indegree = 0",
    "node_without_input": "type_noeud not in ('trigger', 'fin') and indegree = 0",
    "node_without_output": "type_noeud not in ('trigger', 'fin') and outdegree = 0",
    "decision_needs_two_outputs": "type_noeud = 'decision' and outdegree < 2",
    "decision_needs_condition": "type_noeud = 'decision' and conditioned = 0",
    "original_step_unknown": "etape_originale is not null and not exists (select 1 from steps s "
    "where s.workflow_id = deg.workflow_id and s.id = deg.etape_originale)",
}
_NODE_SQL = " union all ".join(
    f"select workflow_id scope_id, 'node' subject_kind, id subject_id, '{rule}' \"rule\" from deg where {cond}"
    for rule, cond in _NODE_RULES.items()
)


@query("v6_node_violations", f"with {CHAIN}, {_DEG} {_NODE_SQL}")
def v6n(spark, d):
    return wr.node_violations(chain_nodes(spark, d), chain_edges(spark, d), chain_steps(spark, d))


def _w(rule: str, cond: str) -> str:
    return (
        f"select workflow_id scope_id, 'workflow' subject_kind, workflow_id subject_id, '{rule}' \"rule\" "
        f"from (select workflow_id, count_if(type_noeud = 'trigger') tr, count_if(type_noeud = 'fin') fi "
        f"from nodes group by 1) where {cond}"
    )


@query("v6_workflow_violations", f"""with recursive {CHAIN}, {_DEG}, {_WALK}, {_SEEN}, {_CLASSES}
{_NODE_SQL} union all {_w('no_trigger', 'tr = 0')} union all {_w('no_end', 'fi = 0')}
union all select distinct workflow_id, 'workflow', workflow_id, 'no_complete_path' from nodes
  where workflow_id not in (select workflow_id from seen join nodes using (workflow_id, id) where type_noeud = 'fin')
union all select workflow_id, 'node', id, 'end_unreachable' from (select workflow_id, id from nodes
  where type_noeud = 'fin' except select workflow_id, id from seen)
union all select workflow_id, 'step', step_id, 'classification_not_exact' from classes c
  where not exists (select 1 from steps s where s.workflow_id = c.workflow_id and s.id = c.step_id)""")
def v6(spark, d):
    nodes = chain_nodes(spark, d)
    headers = nodes.select(
        "workflow_id", F.col("workflow_id").alias("titre_workflow"),
        F.lit("one workflow per user and day").alias("description_transformation"),
    ).distinct()
    return wr.workflow_violations(headers, nodes, chain_edges(spark, d), chain_steps(spark, d))


@query("j8_unreferenced_steps", f"""with {CHAIN} select workflow_id, id from steps s where not exists
(select 1 from nodes n where n.workflow_id = s.workflow_id and n.etape_originale = s.id)""")
def j8(spark, d):
    return wr.unreferenced_steps(chain_steps(spark, d), chain_nodes(spark, d))


@query("v7_workflow_audit", f"""with {CHAIN}, n as (select workflow_id, count(*) nodes, count_if(type_noeud = 'ia') ia,
  count_if(type_noeud = 'automatique') au, count_if(type_noeud = 'humain') hu from nodes group by 1),
l as (select workflow_id, count(*) lost from steps s where not exists
  (select 1 from nodes n where n.workflow_id = s.workflow_id and n.etape_originale = s.id) group by 1)
select workflow_id, coalesce(lost, 0) unreferenced_steps, array_to_string(list_filter([
  case when ia = 0 then 'no_ai_node' end, case when au = 0 then 'no_automatic_node' end,
  case when hu > au then 'more_human_than_automatic' end, case when lost > 0 then 'steps_unreferenced' end,
  case when nodes > 20 then 'large_workflow' end], lambda x: x is not null), '|') warnings
from n left join l using (workflow_id)""")
def v7(spark, d):
    out = wr.audit_workflows(chain_nodes(spark, d), chain_steps(spark, d))
    return out.withColumn("warnings", F.array_join("warnings", "|"))
