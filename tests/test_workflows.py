from tracemill.operators import advisor_rules, diagnosis_rules, graph, transform, workflow_rules
from tracemill.operators.actions import atomic_actions
from tracemill.operators.rules import union_all

NODE = "workflow_id string, id string, label string, type_noeud string, description string, etape_originale string, ord int"
EDGE = "workflow_id string, de string, vers string, condition string, ord int"


def build(spark, nodes, edges, steps=("E1", "E2", "E3"), workflow="w"):
    """nodes: 'id:type[:step]'; edges: 'a>b' or 'a>b?condition'."""
    rows = []
    for i, n in enumerate(nodes):
        name, kind, *step = n.split(":")
        rows.append((workflow, name, f"Node {name}", kind, "does it", step[0] if step else None, i))
    links = []
    for i, e in enumerate(edges):
        path, _, cond = e.partition("?")
        links.append((workflow, *path.split(">"), cond or None, i))
    head = spark.createDataFrame([(workflow, "Title", "Text")], "workflow_id string, titre_workflow string, description_transformation string")
    return (
        head, spark.createDataFrame(rows, NODE), spark.createDataFrame(links, EDGE),
        spark.createDataFrame([(workflow, s) for s in steps], "workflow_id string, id string"),
    )


GOOD_NODES = ["N1:trigger", "N2:automatique:E2", "N3:humain:E3", "N4:fin"]
GOOD_EDGES = ["N1>N2", "N2>N3", "N3>N4"]


def broken(parts):
    return sorted((r.subject_id, r.rule) for r in workflow_rules.workflow_violations(*parts).collect())


def test_valid_workflow(spark):
    parts = build(spark, GOOD_NODES, GOOD_EDGES)
    assert broken(parts) == []
    lists = transform.transformation_lists(transform.classify_steps(parts[3], parts[1])).first()
    assert (lists.automated, lists.human, lists.eliminated) == (["E2"], ["E3"], ["E1"])
    audit = workflow_rules.audit_workflows(parts[1], parts[3]).first()
    assert (audit.unreferenced_steps, audit.warnings) == (1, ["no_ai_node", "steps_unreferenced"])


BREAKS = [
    (GOOD_NODES + ["N3:humain:E3"], GOOD_EDGES, [("N3", "duplicate_id")]),
    (["N1:trigger", "N2:robot", "N4:fin"], ["N1>N2", "N2>N4"], [("N2", "type_not_allowed")]),
    (["N2:humain", "N4:fin"], ["N2>N4"], [("N2", "node_without_input"), ("N4", "end_unreachable"), ("w", "no_complete_path"), ("w", "no_trigger")]),
    (["N1:trigger", "N2:humain"], ["N1>N2"], [("N2", "node_without_output"), ("w", "no_complete_path"), ("w", "no_end")]),
    (GOOD_NODES, GOOD_EDGES + ["N2>N9"], [("N2->N9", "unknown_endpoint")]),
    (GOOD_NODES, GOOD_EDGES + ["N3>N3"], [("N3->N3", "self_loop"), ("w", "cycle")]),
    (GOOD_NODES, GOOD_EDGES + ["N3>N2"], [("w", "cycle")]),
    (GOOD_NODES, GOOD_EDGES + ["N2>N1"], [("N1", "trigger_with_input"), ("w", "cycle")]),
    (GOOD_NODES, GOOD_EDGES + ["N4>N3"], [("N4", "end_with_output"), ("w", "cycle")]),
    (GOOD_NODES + ["N5:ia"], GOOD_EDGES, [("N5", "node_without_input"), ("N5", "node_without_output")]),
    (GOOD_NODES + ["N5:fin"], GOOD_EDGES, [("N5", "end_unreachable"), ("N5", "end_without_input")]),
    (GOOD_NODES + ["N5:decision"], GOOD_EDGES + ["N2>N5", "N5>N4?yes"], [("N5", "decision_needs_two_outputs")]),
    (GOOD_NODES + ["N5:decision"], GOOD_EDGES + ["N2>N5", "N5>N4", "N5>N3? "], [("N5", "decision_needs_condition")]),
    (["N1:trigger", "N2:automatique:E9", "N4:fin"], ["N1>N2", "N2>N4"], [("E9", "classification_not_exact"), ("N2", "original_step_unknown")]),
]


def test_one_break_each_all_workflows_at_once(spark):
    parts = [build(spark, nodes, edges, workflow=f"w{i}") for i, (nodes, edges, _) in enumerate(BREAKS)]
    tables = [union_all(list(frames)) for frames in zip(*parts)]
    found = {f"w{i}": [] for i in range(len(BREAKS))}
    for r in workflow_rules.workflow_violations(*tables).collect():
        found[r.scope_id].append(("w" if r.subject_id == r.scope_id else r.subject_id, r.rule))
    assert [sorted(v) for v in found.values()] == [want for _, _, want in BREAKS]


def test_labels_headers_and_empty_workflow(spark):
    head, nodes, edges, steps = build(spark, GOOD_NODES, GOOD_EDGES)
    long = nodes.replace("Node N2", "one two three four five six").replace("does it", " ")
    found = {(r.subject_id, r.rule) for r in workflow_rules.workflow_violations(head.replace("Title", "\t"), long, edges, steps).collect()}
    assert found == {("w", "title_blank"), ("N2", "label_too_long")} | {(f"N{i}", "description_blank") for i in range(1, 5)}
    empty = spark.createDataFrame([("v", "T", "D")], head.schema)
    got = {(r.scope_id, r.rule) for r in workflow_rules.workflow_violations(empty, nodes.limit(0), edges.limit(0), steps.limit(0)).collect()}
    assert got == {("v", "no_nodes"), ("v", "nothing_classified")}


def test_human_wins_and_other_types_do_not_count(spark):
    _, nodes, _, steps = build(spark, ["A:automatique:E1", "B:humain:E1", "C:ia:E2", "D:trigger:E3", "F:fin:"], [])
    got = {r.step_id: r["class"] for r in transform.classify_steps(steps, nodes).collect()}
    assert got == {"E1": "human", "E2": "eliminated", "E3": "automated"}


def test_tasks(spark):
    head, nodes, edges, _ = build(spark, ["N-1:trigger", "b:ia", "c:decision", "d:humain", "e:robot"], ["N-1>b"])
    got = {r.task_id: (r.operator, r.error) for r in transform.tasks(nodes).collect()}
    assert got == {
        "task_n_1": ("EmptyOperator", None), "task_b": ("PythonOperator", None), "task_c": ("BranchPythonOperator", None),
        "task_d": ("BashOperator", None), "task_e": (None, "unsupported_node_type"),
    }
    assert transform.dependencies(edges).first().dependency == "task_n_1 >> task_b"
    assert transform.dag_ids(head).first().dag_id == "dag_title"


def repaired(spark, nodes, edges):
    _, n, e, _ = build(spark, nodes, edges)
    n2, e2 = graph.ensure_boundaries(n, e)
    return sorted(r.id for r in n2.collect()), sorted((r.de, r.vers) for r in e2.collect())


def test_boundary_repair(spark):
    assert repaired(spark, ["A:humain", "B:humain"], ["A>B"]) == (
        ["A", "B", "fin_1", "trigger_1"], [("A", "B"), ("B", "fin_1"), ("trigger_1", "A")])
    assert repaired(spark, GOOD_NODES, GOOD_EDGES) == (["N1", "N2", "N3", "N4"], [("N1", "N2"), ("N2", "N3"), ("N3", "N4")])
    # all nodes entered: the first one gets the trigger; taken ids are skipped
    assert repaired(spark, ["fin_1:humain", "B:humain", "fin_3:ia"], ["fin_1>B", "B>fin_1", "B>fin_3"]) == (
        ["B", "fin_1", "fin_2", "fin_3", "trigger_1"],
        [("B", "fin_1"), ("B", "fin_3"), ("fin_1", "B"), ("fin_3", "fin_2"), ("trigger_1", "fin_1")])


def test_repair_of_a_workflow_without_nodes(spark):
    head, nodes, edges, _ = build(spark, ["A:humain"], ["A>A"])
    n2, e2 = graph.ensure_boundaries(nodes.limit(0), edges.limit(0), head)
    assert sorted(r.id for r in n2.collect()) == ["fin_1", "trigger_1"]
    assert [(r.de, r.vers) for r in e2.collect()] == [("trigger_1", "fin_1")]


def test_long_chain_and_long_cycle(spark):
    chain = [("c", str(i), str(i + 1)) for i in range(30)]
    ring = [("r", str(i), str((i + 1) % 30)) for i in range(30)]
    edges = spark.createDataFrame(chain + ring, "workflow_id string, de string, vers string")
    assert [r.workflow_id for r in graph.cyclic_workflows(edges).collect()] == ["r"]
    start = spark.createDataFrame([("c", "10")], "workflow_id string, id string")
    assert graph.reachable(edges, start).count() == 21


def advice(spark, workflow="w", **change):
    _, nodes, _, _ = build(spark, GOOD_NODES, GOOD_EDGES, workflow=workflow)
    t = {
        "reports": [("w", "start with the scoring step then extend to interviews once the team is used to it")],
        "recs": [("w", "N2", "Node N2"), ("w", "N3", "Node N3")],
        "tools": [("w", "N2", "Zap", "fits", "faible", "essentiel"), ("w", "N3", "Cal", "fits", "moyen", "optionnel")],
        "stacks": [("w", "minimale", "Zap"), ("w", "complete", "Zap"), ("w", "complete", "Cal")],
    }
    for k, extra in change.items():
        t[k] = extra(t[k])
    schemas = {
        "reports": "workflow_id string, conseil_implementation string",
        "recs": "workflow_id string, noeud_id string, noeud_label string",
        "tools": "workflow_id string, noeud_id string, nom string, justification string, complexite string, priorite string",
        "stacks": "workflow_id string, stack string, nom string",
    }
    own = {k: [(workflow if r[0] == "w" else r[0], *r[1:]) for r in v] for k, v in t.items()}
    df = {k: spark.createDataFrame(v, schemas[k]) for k, v in own.items()}
    names = spark.createDataFrame([("Zap",), ("Cal",), ("Notion",), ("Jira",), ("Linear",)], "name string")
    return df, nodes, names


ADVICE_BREAKS = [
    ({}, []),
    ({"recs": lambda r: r[:1]}, [("N3", "node_not_covered")]),
    ({"recs": lambda r: r + [("w", "N9", "Node N2")]}, [("N9", "no_tools"), ("N9", "unknown_node")]),
    ({"recs": lambda r: r + r[:1]}, [("N2", "duplicate_recommendation")]),
    ({"recs": lambda r: r[:1] + [("w", "N3", "other")]}, [("N3", "unknown_label")]),
    ({"tools": lambda r: r[:1]}, [("N3", "no_tools")]),
    ({"tools": lambda r: r + [("w", "N3", "Foo", "x", "faible", "essentiel")]}, [("N3/Foo", "tool_not_in_catalog")]),
    ({"tools": lambda r: r + r[:1]}, [("N2/Zap", "duplicate_tool")]),
    ({"tools": lambda r: r + [("w", "N3", "Zap", " ", "expert", "critique")]},
     [("N3/Zap", "complexity_not_allowed"), ("N3/Zap", "justification_blank"), ("N3/Zap", "priority_not_allowed")]),
    ({"stacks": lambda r: r[:2] + [("w", "minimale", "Cal")]}, [("Cal", "not_in_complete")]),
    ({"stacks": lambda r: r[1:]}, [("w", "stack_minimale_empty")]),
    ({"stacks": lambda r: r + r[2:]}, [("complete/Cal", "duplicate_entry")]),
    ({"reports": lambda r: [("w", " ")]}, [("w", "advice_blank")]),
]


def test_recommendation_rules_all_reports_at_once(spark):
    cases = [advice(spark, f"w{i}", **change) for i, (change, _) in enumerate(ADVICE_BREAKS)]
    df = {k: union_all([case[0][k] for case in cases]) for k in cases[0][0]}
    nodes, names = union_all([case[1] for case in cases]), cases[0][2]
    found = {f"w{i}": [] for i in range(len(cases))}
    for r in advisor_rules.advisor_violations(df["reports"], df["recs"], df["tools"], df["stacks"], nodes, names).collect():
        found[r.scope_id].append(("w" if r.subject_id == r.scope_id else r.subject_id, r.rule))
    assert [sorted(v) for v in found.values()] == [want for _, want in ADVICE_BREAKS]


def test_label_of_another_node_only_strict(spark):
    df, nodes, names = advice(spark, recs=lambda r: [("w", "N2", "Node N3"), ("w", "N3", "Node N3")])
    args = (df["recs"], df["tools"], nodes)
    assert advisor_rules.recommendation_violations(*args).isEmpty()
    assert [r.rule for r in advisor_rules.recommendation_violations(*args, strict_labels=True).collect()] == ["unknown_label"]


def test_recommendation_audit(spark):
    hubs = [("w", "complete", n) for n in ("Notion", "Jira", "Linear", "T1", "T2", "T3", "T4", "T5", "T6")]
    df, nodes, names = advice(spark, stacks=lambda r: hubs, recs=lambda r: [("v", "x", "y")], reports=lambda r: [("w", "short")])
    got = advisor_rules.audit_advisor(df["reports"], df["recs"], df["stacks"], nodes, names).first().warnings
    assert got == ["stack_large", "several_hub_tools", "tools_not_in_catalog", "coverage_low", "advice_short"]


def test_diagnosis_without_gains(spark):
    gains = "struct<heures_economisees_par_mois:double,economies_mensuelles_devise:double,projection_annuelle:double,mois_retour_investissement:double,detail_du_calcul:string,assumptions:array<string>,confidence:struct<roi_mode:string,monthly_volume:string,manual_time_minutes:string,activity_duration_minutes:string,case_cycle_time_minutes:string,waiting_time_minutes:string>,principales_opportunites:array<string>>"
    diag = spark.createDataFrame(
        [("p", "T", "D", "1", "2h", "95%", "wait", "moyen", None), ("q", "T", "D", "1", "2h", "many", "wait", "maximum", None)],
        "process_id string, titre_processus string, description string, volume_total string, duree_totale_estimee string, "
        f"taux_manuel string, principale_friction string, potentiel_automatisation string, gains {gains}",
    )
    steps = spark.createDataFrame(
        [("p", "E1", "Read", "manuelle", "HR", None), ("p", "E2", " read ", "automatisable", "hr", None)],
        "process_id string, id string, nom string, type_etape string, acteur string, friction string",
    )
    found = sorted((r.scope_id, r.rule) for r in diagnosis_rules.diagnosis_violations(diag, steps).collect())
    assert found == [("p", "duplicate_name_and_actor"), ("q", "manual_share_unreadable"), ("q", "no_steps"), ("q", "potential_not_allowed")]
    audit = {r.process_id: r.warnings for r in diagnosis_rules.audit_diagnoses(diag, steps).collect()}
    assert audit == {"p": ["few_steps", "manual_share_high"], "q": ["few_steps", "manual_share_unreadable"]}


def test_atomic_actions(spark):
    df = spark.createDataFrame(
        [(1, "Bonjour !\n[2024-05-01 09:30] Anna: opened the ticket (billing). Called back the client.\n\nmerci")], "id int, text string"
    )
    rows = atomic_actions(df, keep=["id"]).orderBy("action_no").collect()
    assert [(r.action, r.acteur, str(r.timestamp), r.contexte_supp) for r in rows] == [
        ("opened the ticket (billing).", "Anna", "2024-05-01 09:30:00", "billing"),
        ("Called back the client.", None, "None", None),
    ]
