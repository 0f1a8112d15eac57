"""Workflow graphs: degrees, cycles, reachability and boundary repair, many at once.

``nodes`` is (workflow_id, id, label, type_noeud, description, etape_originale?, ord) and
``edges`` (workflow_id, de, vers, condition?, ord). The loops advance all workflows in
the same round, keep only (workflow, id) keys, and cut lineage with a checkpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.rules import union_all
from tracemill.session import broadcast_if_small, checkpoint

# Rounds kept as separate pieces before they are written as one.
_MAX_PIECES = 8

# Edges that a search goes one a round before chains are contracted.
PLAIN_ROUNDS = 4

# Workflows of up to so many edges are searched for cycles as one row.
ROW_EDGES = 1_000

# Texts and ids of repaired boundaries.
START_LABEL, END_LABEL = "Start", "End"
TRIGGER_PREFIX, FIN_PREFIX = "trigger", "fin"


def node_keys(nodes: DataFrame) -> DataFrame:
    return nodes.select("workflow_id", "id").distinct()


def unknown_endpoints(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Edge ends that are no node: (workflow_id, de, vers, side, id); ``parts`` as for ``degrees``."""
    ends = edges.select(
        "workflow_id",
        "de",
        "vers",
        F.explode(
            F.array(
                F.struct(F.lit("de").alias("side"), F.col("de").alias("id")),
                F.struct(F.lit("vers").alias("side"), F.col("vers").alias("id")),
            )
        ).alias("_e"),
    ).select("workflow_id", "de", "vers", "_e.*")
    return dealt(ends, parts).join(node_keys(dealt(nodes, parts)), ["workflow_id", "id"], "left_anti")


def dealt(df: DataFrame, parts: int | None, key: str = "id") -> DataFrame:
    """``df`` by workflow and ``key`` in ``parts`` partitions, which joins and groups by these need not shuffle again."""
    return df if parts is None else df.repartition(parts, "workflow_id", key)


def self_loops(edges: DataFrame) -> DataFrame:
    """G1: edges from a node to itself."""
    return edges.filter(F.col("de") == F.col("vers"))


def degrees(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Incoming, outgoing and conditioned outgoing edges of every node.

    ``parts``, where given, is the number of partitions of the shuffles.
    """
    nodes = dealt(nodes, parts)
    conditioned = (
        F.coalesce(F.col("condition").rlike(r"(?U)\S"), F.lit(False)).cast("int")
        if "condition" in edges.columns
        else F.lit(0)
    )
    ends = edges.select(
        "workflow_id",
        F.explode(
            F.array(
                F.struct(F.col("de").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), conditioned.alias("c")),
                F.struct(F.col("vers").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("c")),
            )
        ).alias("_e"),
    ).select("workflow_id", "_e.*")
    counts = dealt(ends, parts).groupBy("workflow_id", "id").agg(
        F.sum("i").alias("_in"), F.sum("o").alias("_out"), F.sum("c").alias("_cond")
    )
    zero = F.lit(0).cast("long")
    return nodes.join(counts, ["workflow_id", "id"], "left").select(
        *[nodes[c] for c in nodes.columns],
        F.coalesce("_in", zero).alias("indegree"),
        F.coalesce("_out", zero).alias("outdegree"),
        F.coalesce("_cond", zero).alias("conditioned"),
    )


def _peel(edges: DataFrame) -> DataFrame:
    """Drop edges that leave a node nothing enters, or enter a node nothing leaves."""
    entered = edges.select("workflow_id", F.col("vers").alias("de")).distinct()
    left = edges.select("workflow_id", F.col("de").alias("vers")).distinct()
    return edges.join(entered, ["workflow_id", "de"], "left_semi").join(
        left, ["workflow_id", "vers"], "left_semi"
    )


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges on cycles, or on paths between cycles; empty for acyclic workflows.

    Peels from both ends, so the number of rounds is at most a quarter of the longest path.
    """
    current = checkpoint(edges.select("workflow_id", "de", "vers").distinct())
    size = current.count()
    while size:
        current = checkpoint(_peel(_peel(current)).select("workflow_id", "de", "vers"))
        previous, size = size, current.count()
        if size == previous:
            break
    return current


def chain_roots(single: DataFrame) -> DataFrame:
    """(workflow_id, id, root): from ``id`` along ``up`` to the first node that is no ``id`` itself.

    Null on a circle. Each round doubles the steps that a node has gone, so their number is the
    logarithm of the longest chain.
    """
    now = checkpoint(single.select("workflow_id", "id", "up", F.lit(False).alias("done")))
    total = left = now.count()
    steps = 1
    while left and steps <= total:
        above = now.select("workflow_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("done").alias("_done"))
        now = checkpoint(
            now.join(above, ["workflow_id", "up"], "left").select(
                "workflow_id", "id", F.coalesce("_up", "up").alias("up"), (F.col("done") | F.col("_up").isNull() | F.col("_done")).alias("done")
            )
        )
        left = now.filter(~F.col("done")).count()
        steps *= 2
    return now.select("workflow_id", "id", F.when(F.col("done"), F.col("up")).alias("root"))


def _singles(edges: DataFrame, at: str, other: str) -> DataFrame:
    """(workflow_id, id, up): nodes with one edge at their ``at`` side, and its other end."""
    return edges.groupBy("workflow_id", F.col(at).alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min(other).alias("up")).filter(
        F.col("_n") == 1
    ).drop("_n")


def _contracted(edges: DataFrame, at: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(edges, workflows with a circle): nodes with one edge at ``at`` become one with its other end.

    That keeps every cycle, as all paths through such a node take that edge.
    """
    single = checkpoint(_singles(edges, at, other))
    if single.isEmpty():
        return edges, single.select("workflow_id")
    roots = checkpoint(chain_roots(single))
    circles = roots.filter(F.col("root").isNull()).select("workflow_id").distinct()
    kept = edges.join(single.select("workflow_id", F.col("id").alias(at)), ["workflow_id", at], "left_anti")
    moved = kept.join(roots.withColumnRenamed("id", other), ["workflow_id", other], "left")
    out = moved.select("workflow_id", F.col(at), F.coalesce("root", other).alias(other)).distinct()
    out = out.join(circles, "workflow_id", "left_anti")
    return checkpoint(out.select("workflow_id", "de", "vers")), circles


@F.pandas_udf(T.BooleanType())
def _has_cycle(sources: pd.Series, targets: pd.Series) -> pd.Series:
    """Whether edges are left once those of nodes that nothing enters are dropped, again and again."""
    out = []
    for de, vers in zip(sources, targets):
        after: dict = {}
        entered: dict = {}
        for a, b in zip(de, vers):
            after.setdefault(a, []).append(b)
            entered[b] = entered.get(b, 0) + 1
        free = [a for a in after if a not in entered]
        left = len(de)
        while free:
            for b in after.get(free.pop(), ()):
                left -= 1
                entered[b] -= 1
                if not entered[b]:
                    free.append(b)
        out.append(left > 0)
    return pd.Series(out, dtype="bool")


def cyclic_workflows(edges: DataFrame, row_edges: int = ROW_EDGES) -> DataFrame:
    """Workflows that contain a cycle.

    Workflows of at most ``row_edges`` edges are searched one a row; rounds go over the larger ones only.
    """
    whole = checkpoint(edges.select("workflow_id", "de", "vers").na.drop().distinct())
    sizes = whole.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("_n"))
    large = checkpoint(sizes.filter(F.col("_n") > row_edges).select("workflow_id"))
    if large.isEmpty():
        return _cyclic_rows(whole)
    large = broadcast_if_small(large)
    rest = _cyclic_rows(whole.join(large, "workflow_id", "left_anti"))
    return rest.unionByName(_cyclic_rounds(whole.join(large, "workflow_id", "left_semi")))


def _cyclic_rows(edges: DataFrame) -> DataFrame:
    listed = edges.groupBy("workflow_id").agg(F.collect_list(F.struct("de", "vers")).alias("_e"))
    return listed.filter(_has_cycle(F.col("_e.de"), F.col("_e.vers"))).select("workflow_id")


def _cyclic_rounds(edges: DataFrame) -> DataFrame:
    """Workflows with a cycle, all of them advanced in the same round.

    A round drops edges at nodes that nothing enters or leaves, and contracts chains. A workflow that
    loses no edge has only nodes that are entered, and so a cycle. Rounds grow with the depth of what
    chains leave: nodes that several edges enter and several leave.
    """
    current = checkpoint(edges.select("workflow_id", "de", "vers").distinct())
    found = [current.select("workflow_id").filter("false")]
    while not current.isEmpty():
        peeled = checkpoint(_peel(current).select("workflow_id", "de", "vers"))
        had = current.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("_had"))
        has = peeled.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("_has"), F.bool_or(F.col("de") == F.col("vers")).alias("_self"))
        stuck = checkpoint(had.join(has, "workflow_id").filter((F.col("_had") == F.col("_has")) | F.col("_self")).select("workflow_id"))
        found.append(stuck)
        current = peeled.join(stuck, "workflow_id", "left_anti")
        for at, other in (("vers", "de"), ("de", "vers")):
            current, circles = _contracted(current, at, other)
            found.append(circles)
        looped = checkpoint(current.filter(F.col("de") == F.col("vers")).select("workflow_id").distinct())
        found.append(looped)
        current = checkpoint(current.join(looped, "workflow_id", "left_anti"))
        found = [checkpoint(union_all(found).distinct())]
    return union_all(found).distinct()


def _walk(links: DataFrame, frontier: DataFrame, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """(what is reached, whether that is all), one edge a round."""
    found, n = [frontier], 0
    while not frontier.isEmpty():
        if n == rounds:
            return union_all(found), False
        n += 1
        reached = (
            links.join(frontier, ["workflow_id", "id"])
            .select("workflow_id", F.col("vers").alias("id"))
            .distinct()
        )
        frontier = checkpoint(reached.join(union_all(found), ["workflow_id", "id"], "left_anti"))
        found.append(frontier)
        if len(found) > _MAX_PIECES:
            found = [checkpoint(union_all(found))]
    return union_all(found), True


def reachable(edges: DataFrame, sources: DataFrame, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """(workflow_id, id) reachable from ``sources``, themselves included.

    After some plain rounds a node that one edge enters is reached just if the first node before it
    that is entered otherwise, or was reached before, is; so chains cost the logarithm of their length
    and rounds go over the other nodes only.
    """
    links = checkpoint(edges.select("workflow_id", F.col("de").alias("id"), "vers").distinct())
    start = checkpoint(sources.select("workflow_id", "id").distinct())
    seen, whole = _walk(links, start, plain_rounds)
    if whole:
        return seen
    seen = checkpoint(seen)
    ahead = links.join(seen.withColumnRenamed("id", "vers"), ["workflow_id", "vers"], "left_anti")
    single = checkpoint(_singles(ahead.withColumnRenamed("id", "de"), "vers", "de"))
    roots = checkpoint(chain_roots(single))
    kept = ahead.join(single.select("workflow_id", F.col("id").alias("vers")), ["workflow_id", "vers"], "left_anti")
    jumps = checkpoint(
        kept.join(roots.withColumn("_single", F.lit(True)), ["workflow_id", "id"], "left")
        .filter(F.col("root").isNotNull() | F.col("_single").isNull())  # no path comes to a circle of such nodes
        .select("workflow_id", F.coalesce("root", "id").alias("id"), "vers").distinct()
    )
    reached, _ = _walk(jumps, seen)
    reached = checkpoint(reached)
    along = roots.join(reached.withColumnRenamed("id", "root"), ["workflow_id", "root"], "left_semi").select("workflow_id", "id")
    return reached.unionByName(along)


def unreachable_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """End nodes that no trigger reaches."""
    typed = nodes.select("workflow_id", "id", "type_noeud").distinct()
    seen = reachable(edges, typed.filter(F.col("type_noeud") == "trigger"))
    return typed.filter(F.col("type_noeud") == "fin").join(seen, ["workflow_id", "id"], "left_anti").select(
        "workflow_id", "id"
    )


def workflows_without_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Workflows in which no trigger reaches any end."""
    typed = nodes.select("workflow_id", "id", "type_noeud").distinct()
    seen = reachable(edges, typed.filter(F.col("type_noeud") == "trigger"))
    complete = typed.filter(F.col("type_noeud") == "fin").join(seen, ["workflow_id", "id"], "left_semi")
    return typed.select("workflow_id").distinct().join(
        complete.select("workflow_id").distinct(), "workflow_id", "left_anti"
    )


def unique_node_id(nodes: DataFrame, scopes: DataFrame, prefix: str) -> DataFrame:
    """Smallest free ``prefix_i`` (i >= 1) per workflow: (workflow_id, id)."""
    number = F.regexp_extract("id", f"^{prefix}_([1-9][0-9]{{0,17}})$", 1).try_cast("long")
    used = nodes.select("workflow_id", number.alias("i")).filter(F.col("i").isNotNull()).distinct()
    candidates = scopes.select("workflow_id", F.lit(1).cast("long").alias("i")).unionByName(
        used.join(scopes.select("workflow_id"), "workflow_id", "left_semi").select(
            "workflow_id", (F.col("i") + 1).alias("i")
        )
    )
    free = candidates.distinct().join(used, ["workflow_id", "i"], "left_anti")
    return free.groupBy("workflow_id").agg(
        F.concat(F.lit(f"{prefix}_"), F.min("i").cast("string")).alias("id")
    )


def ensure_boundaries(
    nodes: DataFrame, edges: DataFrame, workflows: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Repaired (nodes, edges).

    A workflow without trigger gets one, linked to all nodes nothing enters, or to its
    first node when every node is entered. A workflow without end gets one. Nodes that
    nothing leaves, ends aside, are linked to the first end. ``workflows`` may add
    workflow ids that have no node yet.
    """
    all_nodes, all_edges = nodes, edges
    # The decisions need keys only; written once, they serve every branch below.
    nodes = checkpoint(nodes.select("workflow_id", "id", "type_noeud", "ord"))
    edges = checkpoint(edges.select("workflow_id", "de", "vers", "ord"))
    scopes = nodes.select("workflow_id")
    if workflows is not None:
        scopes = scopes.unionByName(workflows.select("workflow_id"))
    scopes = scopes.distinct()
    kinds = nodes.groupBy("workflow_id").agg(
        F.count_if(F.col("type_noeud") == "trigger").alias("_triggers"),
        F.count_if(F.col("type_noeud") == "fin").alias("_fins"),
        F.min_by("id", "ord").alias("_first"),
        F.min_by(F.when(F.col("type_noeud") == "fin", F.col("id")), F.when(F.col("type_noeud") == "fin", F.col("ord"))).alias("_fin"),
        F.max("ord").alias("_ord"),
    )
    state = checkpoint(scopes.join(kinds, "workflow_id", "left"))
    no_trigger = state.filter(F.coalesce("_triggers", F.lit(0)) == 0)
    no_fin = state.filter(F.coalesce("_fins", F.lit(0)) == 0)
    trigger_ids = unique_node_id(nodes, no_trigger, TRIGGER_PREFIX)
    fin_ids = unique_node_id(nodes, no_fin, FIN_PREFIX)

    added_nodes = _boundary(no_trigger, trigger_ids, 1, START_LABEL, "trigger", "entry added", all_nodes).unionByName(
        _boundary(no_fin, fin_ids, 2, END_LABEL, "fin", "end added", all_nodes)
    )

    placed = checkpoint(degrees(nodes.select("workflow_id", "id", "type_noeud").distinct(), edges))
    roots = placed.filter(F.col("indegree") == 0).select("workflow_id", F.col("id").alias("vers"))
    rootless = no_trigger.filter(F.col("_first").isNotNull()).join(
        roots.select("workflow_id").distinct(), "workflow_id", "left_anti"
    )
    entries = roots.unionByName(rootless.select("workflow_id", F.col("_first").alias("vers")))
    from_trigger = trigger_ids.select("workflow_id", F.col("id").alias("de")).join(entries, "workflow_id")

    ends = state.join(fin_ids, "workflow_id", "left").select(
        "workflow_id", F.coalesce("_fin", "id").alias("vers")
    )
    leaves = placed.filter((F.col("outdegree") == 0) & (F.col("type_noeud") != "fin")).select(
        "workflow_id", F.col("id").alias("de")
    )
    lone_triggers = trigger_ids.select("workflow_id", F.col("id").alias("de")).join(
        entries.select("workflow_id").distinct(), "workflow_id", "left_anti"
    )
    to_fin = leaves.unionByName(lone_triggers).join(ends, "workflow_id")

    last = edges.groupBy("workflow_id").agg(F.max("ord").alias("_last"))
    added_edges = (
        from_trigger.select("workflow_id", "de", "vers", F.lit(1).alias("_step"))
        .unionByName(to_fin.select("workflow_id", "de", "vers", F.lit(2).alias("_step")))
        .join(last, "workflow_id", "left")
        .withColumn("_new_ord", F.coalesce("_last", F.lit(0)) + F.col("_step"))
    )
    filled = {"workflow_id": F.col("workflow_id"), "de": F.col("de"), "vers": F.col("vers"), "ord": F.col("_new_ord")}
    return all_nodes.unionByName(added_nodes), all_edges.unionByName(_fill(added_edges, filled, all_edges))


def _boundary(
    state: DataFrame, ids: DataFrame, step: int, label: str, kind: str, text: str, like: DataFrame
) -> DataFrame:
    rows = state.select("workflow_id", "_ord").join(ids, "workflow_id")
    filled = {
        "workflow_id": F.col("workflow_id"),
        "id": F.col("id"),
        "label": F.lit(label),
        "type_noeud": F.lit(kind),
        "description": F.lit(text),
        "ord": F.coalesce("_ord", F.lit(0)) + step,
    }
    return _fill(rows, filled, like)


def _fill(rows: DataFrame, values: dict[str, Column], like: DataFrame) -> DataFrame:
    """Project ``rows`` to the columns and types of ``like``; the rest is null."""
    return rows.select(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )
