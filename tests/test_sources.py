import json

import pytest

from tracemill.operators.columns import MissingColumns, pick_any_case
from tracemill.operators.normalize import normalize
from tracemill.operators.resolve import resolve_time_context
from tracemill.plans.analyses import analyse_time, mine_repetitions
from tracemill.sources import catalog, documents, exports

TICKETS = [
    {"id": "T1", "category": "Login", "status": "closed", "created": "2024-03-04 08:00", "resolved": "2024-03-04 09:30"},
    {"id": "T2", "category": "Login", "status": "open", "created": "2024-03-04 10:00", "resolved": None},
    {"id": "T3", "category": "Invoice", "status": "closed", "created": "2024-03-05 08:00", "resolved": "2024-03-05 08:10"},
    {"id": "T4", "category": None, "status": "closed", "created": "2024-03-08 07:59", "resolved": "not yet"},
]
STAGES = [
    {"etape": "Brief", "action": "write", "duree_moyenne_jours": 2.0, "count": 4},
    {"etape": "Review", "action": "comment", "duree_moyenne_jours": 1.5, "count": 3},
    {"etape": "Publish", "action": "upload", "duree_moyenne_jours": 0.5, "count": 1},
]


def write(tmp_path, name, value):
    (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(tmp_path / name)


def records(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, document string")
    return sorted((r.doc, r.record_no, r.record) for r in documents.extract_records(df).collect())


def test_record_list_search(spark):
    assert records(
        spark,
        '[{"a":1},{"a":2}]',
        '{"source":"x","pipeline":[{"e":"p"}],"also":[{"e":"q"}]}',
        '{"key":"value"}',
        '{"tags":["p","q"],"records":[{"id":1}]}',
        '{"z.last":[],"note":"[{","m":[{"u":null},{"u":1}]}',
        "no json",
    ) == [
        (0, 0, '{"a":1}'), (0, 1, '{"a":2}'), (1, 0, '{"e":"p"}'), (3, 0, '{"id":1}'),
        (4, 0, '{"u":null}'), (4, 1, '{"u":1}'),
    ]


def test_documents_without_records(spark, tmp_path):
    df = spark.createDataFrame([(0, '{"a":[1]}'), (1, '[{"a":1}]')], "doc int, document string")
    assert [r.doc for r in documents.documents_without_records(df).collect()] == [0]
    with pytest.raises(documents.NoRecords):
        documents.load_table(spark, write(tmp_path, "none.json", {"a": "b"}))


def test_load_keeps_document_order_of_lists(spark, tmp_path):
    path = write(tmp_path, "stages.json", {"source": "s", "pipeline": STAGES, "a_candidates": [{"id": 1}]})
    table = documents.load_table(spark, path)
    assert table.count() == 3 and "etape" in table.columns
    assert dict(table.dtypes)["duree_moyenne_jours"] == "double"


def test_upload(spark, tmp_path):
    (tmp_path / "u.csv").write_text('id,action\n1,"a\nb"\n2,c\n')
    assert sorted(r.action for r in documents.read_upload(spark, str(tmp_path / "u.csv")).collect()) == ["a\nb", "c"]
    assert documents.read_upload(spark, write(tmp_path, "u.json", TICKETS)).count() == 4


def test_normalize_tickets(spark, tmp_path):
    table = documents.load_table(spark, write(tmp_path, "t.json", {"tickets": TICKETS}))
    rows = {r["id"]: r for r in normalize(table).collect()}
    assert set(rows) == {"T1", "T2", "T3"}
    assert (rows["T1"].content, rows["T1"].duration_minutes) == ("Login", 90.0)
    assert rows["T2"].duration_minutes is None and rows["T3"].duration_minutes == 10.0


def test_normalize_units_and_errors(spark):
    df = spark.createDataFrame([("Screening", "3.2"), (None, "1"), ("x", "bad")], "action string, duree_moyenne_jours string")
    assert [r.duration_minutes for r in normalize(df, units="raw").collect()] == [3.2, None]
    assert [r.duration_minutes for r in normalize(df).collect()] == [pytest.approx(4608.0), None]
    with pytest.raises(MissingColumns, match="score"):
        normalize(spark.createDataFrame([(1, 2)], "score int, priority int"))
    mapped = normalize(spark.createDataFrame([("t",)], "body string"), {"body": "content"})
    assert mapped.columns == ["content"]


def test_column_search_ignores_case():
    assert pick_any_case(["Status", "EVENT"], ["activity", "action", "event", "step", "status"]) == "EVENT"
    assert pick_any_case(["ID", "id"], ["id"]) == "id"


def test_resolution_cases(spark):
    def resolve(ddl, **user):
        df = spark.createDataFrame([], ddl)
        table, context = resolve_time_context(df, user)
        return context.case, context.mode, context.report_path(), table

    assert resolve("id int, action string, created string, started_at string")[:3] == ("A", "observed", "event_log")
    assert resolve("id int, action string, created string")[:3] == ("A", "estimated", "event_log")
    assert resolve("action string, ts string, started_at string")[:3] == ("A", "estimated", "event_log")
    assert resolve("action string, duree_minutes int, jours int")[:3] == ("B", "estimated", "duration_column")
    assert resolve("action string, temps_heures int, jours int")[:3] == ("C", "estimated", "duration_column")
    assert resolve("action string, jours int")[:3] == ("D", "estimated", "duration_column")
    assert resolve("action string", monthly_volume=1, manual_time_minutes=2)[:3] == ("E", "provided", "user_input")
    assert resolve("action string", monthly_volume=1)[:3] == ("F", "insufficient", "none")
    assert resolve("x string, created string")[:3] == ("none", "insufficient", "none")
    _, _, _, table = resolve("action string, jours int")
    assert {"activity", "case_id", "duration_minutes"} <= set(table.columns)


def test_context_row(spark):
    _, context = resolve_time_context(spark.createDataFrame([], "action string, jours int"))
    row = context.as_row(spark).first()
    assert (row.resolution, row.duration_minutes_col, row.can_run_time_quantification) == ("D", "duration_minutes", True)


def test_time_analysis_of_tickets(spark, tmp_path):
    table = documents.load_table(spark, write(tmp_path, "t.json", {"tickets": TICKETS}))
    result = analyse_time(table, hourly=25.0, process="support")
    report = result.report.first()
    # four tickets over 3 days 23:59, one event each
    assert report.monthly_volume.value == 30.0 and report.monthly_volume.confidence_level == "estimated"
    assert report.case_cycle_time_minutes.value == 0.0
    assert report.waiting_time_minutes.confidence_level == "missing"
    assert not report.can_compute_partial_roi
    assert result.savings.first().violation == "roi_blocked"
    assert result.violations.isEmpty()


def test_time_analysis_of_stages(spark):
    table = spark.createDataFrame(STAGES)
    result = analyse_time(table, 25.0, "stages", {"manual_time_minutes": 60.0, "monthly_volume": 10})
    report = result.report.first()
    assert report.activity_duration_minutes.value == 2160.0
    assert report.case_cycle_time_minutes.value == 5760.0
    assert report.monthly_volume.confidence_level == report.manual_time_minutes.confidence_level == "provided"
    assert result.savings.first().economies_mensuelles == round(10 * 46.5 / 60 * 25, 2)
    assert analyse_time(spark.createDataFrame([], "action string"), 25.0).report is None


def test_repetition_payload(spark):
    texts = ["reset the password"] * 5 + ["send the invoice again"] * 4 + ["something else entirely"]
    rows = spark.createDataFrame([(i, t, 2.0) for i, t in enumerate(texts)], "record_no long, content string, duration_minutes double")
    doc = mine_repetitions(rows, "demo", min_cluster_size=3).first()
    assert doc.metriques_globales.asDict() == {"volume_total_lignes": 10, "temps_total_analyse_minutes": 20.0}
    assert [(c.cluster_id, c.frequence, c.temps_total_perdu_minutes) for c in doc.clusters_repetitifs] == [("C0", 5, 10.0), ("C1", 4, 8.0)]
    assert doc.clusters_repetitifs[1].exemples_representatifs == ["send the invoice again"] * 3


def test_catalog(spark):
    df = spark.createDataFrame([(" Zap ",), ("Zap",), ("",), (None,), ("Make",)], "name string")
    names = catalog.require_names(catalog.catalog_names(df))
    assert sorted(r.name for r in names.collect()) == ["Make", "Zap"]
    with pytest.raises(catalog.EmptyCatalog):
        catalog.require_names(catalog.catalog_names(df.filter("name = ''")))


def test_export(spark, tmp_path):
    a = spark.createDataFrame([("p", "title")], "process_id string, titre string")
    b = spark.createDataFrame([("p", 3)], "process_id string, nodes int")
    c = spark.createDataFrame([("q", 1)], "process_id string, recs int")
    out = exports.export_documents(a, b, c, "process_id")
    got = {r.process_id: json.loads(r.document) for r in out.collect()}
    assert got["p"] == {"diagnosis": {"titre": "title"}, "workflow": {"nodes": 3}, "recommendations": None}
    assert got["q"]["recommendations"] == {"recs": 1}
    exports.write_json(out, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
