"""Checks and audit of workflow graphs (V6, V7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import non_blank, word_count
from tracemill.operators import graph
from tracemill.operators.rules import duplicates, union_all, violations, warnings_array
from tracemill.operators.transform import classify_steps, empty_transformations, overlapping_classes, uncovered_steps
from tracemill.session import checkpoint, shuffle_parts

# Fixed values.
NODE_TYPES = ["trigger", "automatique", "humain", "decision", "fin", "ia"]
MAX_LABEL_WORDS = 5
LARGE_WORKFLOW_NODES = 20
MIN_DECISION_EDGES = 2
# End of fixed values.


def _is(kind: str) -> Column:
    return F.col("type_noeud") == kind


def header_violations(workflows: DataFrame) -> DataFrame:
    return violations(
        workflows,
        "workflow",
        "workflow_id",
        None,
        {
            "title_blank": ~non_blank("titre_workflow"),
            "description_blank": ~non_blank("description_transformation"),
        },
    )


def node_violations(
    nodes: DataFrame, edges: DataFrame, steps: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """Texts, label length, type, original step (J1), connections (G3) and decisions.

    One pass over nodes joined with their degrees and, if given, the known steps. ``parts`` is the number
    of partitions, by default after the number of nodes.
    """
    if parts is None:
        parts = shuffle_parts(nodes.sparkSession, nodes.count())
    rows = graph.degrees(nodes, edges, parts)
    rules: dict[str, Column] = {
        "id_blank": ~non_blank("id"),
        "label_blank": ~non_blank("label"),
        "description_blank": ~non_blank("description"),
        "label_too_long": word_count("label") > MAX_LABEL_WORDS,
        "type_not_allowed": ~F.coalesce(F.col("type_noeud").isin(NODE_TYPES), F.lit(False)),
        **connectivity_rules(),
        **decision_rules(),
    }
    if steps is not None:
        known = steps.select(
            "workflow_id", F.col("id").alias("etape_originale"), F.lit(True).alias("_known")
        )
        known = graph.dealt(known, parts, "etape_originale").distinct()
        rows = graph.dealt(rows, parts, "etape_originale").join(known, ["workflow_id", "etape_originale"], "left")
        rules["original_step_unknown"] = F.col("etape_originale").isNotNull() & F.col("_known").isNull()
    return violations(rows, "node", "workflow_id", "id", rules)


def connectivity_rules() -> dict[str, Column]:
    """G3."""
    none_in, none_out = F.col("indegree") == 0, F.col("outdegree") == 0
    inner = ~F.coalesce(F.col("type_noeud").isin("trigger", "fin"), F.lit(False))
    return {
        "trigger_with_input": _is("trigger") & ~none_in,
        "trigger_without_output": _is("trigger") & none_out,
        "end_with_output": _is("fin") & ~none_out,
        "end_without_input": _is("fin") & none_in,
        "node_without_input": inner & none_in,
        "node_without_output": inner & none_out,
    }


def decision_rules() -> dict[str, Column]:
    """G5."""
    return {
        "decision_needs_two_outputs": _is("decision") & (F.col("outdegree") < MIN_DECISION_EDGES),
        "decision_needs_condition": _is("decision") & (F.col("conditioned") == 0),
    }


def type_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per type and workflow."""
    return nodes.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        *[F.count_if(_is(t)).alias(f"{t}_count") for t in NODE_TYPES],
    )


def workflow_violations(
    workflows: DataFrame, nodes: DataFrame, edges: DataFrame, steps: DataFrame | None = None
) -> DataFrame:
    """V6: all rules of workflows. ``steps`` (workflow_id, id) adds the diagnosis rules.

    Each input is derived once and written, as a dozen rules read it.
    """
    workflows, nodes, edges = map(checkpoint, (workflows, nodes, edges))
    steps = None if steps is None else checkpoint(steps)
    parts = shuffle_parts(nodes.sparkSession, max(df.count() for df in (workflows, nodes, edges, steps) if df is not None))
    nodes, edges = checkpoint(graph.dealt(nodes, parts)), checkpoint(graph.dealt(edges, parts, "de"))
    steps = None if steps is None else checkpoint(graph.dealt(steps, parts))
    counted = workflows.select("workflow_id").distinct().join(type_counts(nodes), "workflow_id", "left")
    empty = F.col("nodes").isNull()
    found = [
        header_violations(workflows),
        violations(
            counted,
            "workflow",
            "workflow_id",
            None,
            {
                "no_nodes": empty,
                "no_trigger": ~empty & (F.col("trigger_count") == 0),
                "no_end": ~empty & (F.col("fin_count") == 0),
            },
        ),
        _all_rows(duplicates(nodes, ["workflow_id", "id"]), "node", "id", "duplicate_id"),
        node_violations(nodes, edges, steps, parts),
        _all_rows(graph.unknown_endpoints(nodes, edges, parts), "edge", _edge(), "unknown_endpoint"),
        _all_rows(graph.self_loops(edges), "edge", _edge(), "self_loop"),
        _all_rows(graph.cyclic_workflows(edges), "workflow", F.col("workflow_id"), "cycle"),
        *path_violations(nodes, edges),
    ]
    if steps is not None:
        classes = checkpoint(classify_steps(steps, nodes))
        found += [
            _all_rows(uncovered_steps(classes, steps, parts), "step", "step_id", "classification_not_exact"),
            _all_rows(overlapping_classes(classes, parts), "step", "step_id", "step_in_two_classes"),
            _all_rows(
                empty_transformations(classes, workflows), "workflow", F.col("workflow_id"), "nothing_classified"
            ),
        ]
    return union_all(found)


def path_violations(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """No trigger-to-end path at all, and ends out of reach; one search serves both."""
    typed = nodes.select("workflow_id", "id", "type_noeud").distinct()
    seen = checkpoint(graph.reachable(edges, typed.filter(_is("trigger"))))
    ends = typed.filter(_is("fin"))
    reached = ends.join(seen, ["workflow_id", "id"], "left_semi").select("workflow_id").distinct()
    return [
        _all_rows(
            typed.select("workflow_id").distinct().join(reached, "workflow_id", "left_anti"),
            "workflow", F.col("workflow_id"), "no_complete_path",
        ),
        _all_rows(ends.join(seen, ["workflow_id", "id"], "left_anti"), "node", "id", "end_unreachable"),
    ]


def _edge() -> Column:
    return F.concat_ws("->", "de", "vers")


def _all_rows(df: DataFrame, kind: str, subject: str | Column, rule: str) -> DataFrame:
    return violations(df, kind, "workflow_id", subject, {rule: F.lit(True)})


def unreferenced_steps(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps that no node names."""
    named = nodes.select("workflow_id", F.col("etape_originale").alias("id")).distinct()
    return steps.select("workflow_id", "id").distinct().join(named, ["workflow_id", "id"], "left_anti")


def audit_workflows(nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """V7: warnings per workflow, with the number of unreferenced steps."""
    counts = type_counts(nodes)
    if steps is None:
        counts = counts.withColumn("unreferenced_steps", F.lit(0).cast("long"))
    else:
        lost = unreferenced_steps(steps, nodes).groupBy("workflow_id").agg(
            F.count(F.lit(1)).alias("unreferenced_steps")
        )
        counts = counts.join(lost, "workflow_id", "left").na.fill(0, ["unreferenced_steps"])
    return counts.select(
        "workflow_id",
        "unreferenced_steps",
        warnings_array(
            {
                "no_ai_node": F.col("ia_count") == 0,
                "no_automatic_node": F.col("automatique_count") == 0,
                "more_human_than_automatic": F.col("humain_count") > F.col("automatique_count"),
                "steps_unreferenced": F.col("unreferenced_steps") > 0,
                "large_workflow": F.col("nodes") > LARGE_WORKFLOW_NODES,
            }
        ).alias("warnings"),
    )
