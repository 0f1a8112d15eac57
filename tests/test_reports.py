import pytest
from pyspark.sql import functions as F

from tracemill.operators import metrics as mt
from tracemill.operators import roi, time_rules
from tracemill.operators.telemetry import telemetry_summary

FIELDS = "name string, unit string, value double, confidence_level string, source string, hypothesis string, notes array<string>"
REPORT = (
    "process_id string, " + ", ".join(f"{m} struct<{FIELDS.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>" for m in mt.METRICS)
    + ", warnings array<string>, can_compute_full_roi boolean, can_compute_partial_roi boolean"
)
VALUES = {"monthly_volume": 100.0, "activity_duration_minutes": 10.0, "case_cycle_time_minutes": 20.0, "manual_time_minutes": 10.0, "waiting_time_minutes": 5.0}


def report(spark, levels=None, values=None, hypotheses=None, units=None, flags=None):
    levels, values = levels or {}, {**VALUES, **(values or {})}
    row = ["p"]
    for m in mt.METRICS:
        level = levels.get(m, "provided")
        hyp = (hypotheses or {}).get(m, "because" if level == "estimated" else None)
        row.append((m, (units or {}).get(m, mt.UNITS[m]), None if level == "missing" else values[m], level, "test", hyp, ["note"]))
    critical = [levels.get(m, "provided") for m in mt.CRITICAL]
    full = all(lv in ("provided", "observed") for lv in critical)
    partial = "missing" not in critical
    row += [[], *(flags or (full, partial))]
    return spark.createDataFrame([tuple(row)], REPORT)


def rules(df):
    return sorted(r.rule for r in time_rules.time_violations(df).collect())


def test_clean_report(spark):
    assert rules(report(spark)) == []


@pytest.mark.parametrize(
    "kwargs, want",
    [
        (dict(levels={"manual_time_minutes": "estimated"}, hypotheses={"manual_time_minutes": " "}), ["estimated_without_hypothesis"]),
        (dict(values={"manual_time_minutes": 12.0, "case_cycle_time_minutes": 8.0}), ["activity_above_cycle", "manual_above_cycle"]),
        (dict(values={"waiting_time_minutes": 21.0}), ["waiting_above_cycle"]),
        (dict(values={"waiting_time_minutes": -1.0}), ["value_negative"]),
        (dict(values={"monthly_volume": None}), ["value_absent"]),
        (dict(units={"monthly_volume": "minutes"}), ["unit_unexpected"]),
        (dict(units={"waiting_time_minutes": " "}), ["unit_blank"]),
        (dict(levels={"waiting_time_minutes": "sure"}), ["level_not_allowed"]),
        (dict(levels={"manual_time_minutes": "estimated"}, flags=(True, True)), ["full_roi_flag_wrong"]),
        (dict(levels={"monthly_volume": "missing"}, flags=(False, True)), ["partial_roi_flag_wrong"]),
        (dict(flags=(True, False)), ["full_without_partial"]),
    ],
)
def test_time_rules(spark, kwargs, want):
    assert rules(report(spark, **kwargs)) == want


def test_missing_with_value(spark):
    df = report(spark).withColumn("waiting_time_minutes", F.col("waiting_time_minutes").withField("confidence_level", F.lit("missing")))
    assert rules(df) == ["missing_with_value"]


def test_missing_metric_skips_cycle_rules(spark):
    df = report(spark, levels={"waiting_time_minutes": "missing"}, values={"manual_time_minutes": 99.0})
    assert rules(df) == []


@pytest.mark.parametrize("levels, mode", [({}, "full"), ({"manual_time_minutes": "estimated"}, "partial")])
def test_savings_modes(spark, levels, mode):
    got = roi.compute_roi(report(spark, levels), 50.0).first()
    assert (got.confidence.roi_mode, got.violation) == (mode, None)
    assert (got.heures_economisees_par_mois, got.economies_mensuelles, got.projection_annuelle) == (16.67, 833.33, 10000.0)
    assert got.detail_calcul == "100.00 cas/mois × 10.00 min économisées/cas = 1000.00 min/mois = 16.67 h/mois"
    assert got.assumptions == ["automation_rate=1.00", "residual_manual_time_minutes=0.00", "taux_horaire=50.00"]


def test_savings_with_residual_and_cost(spark):
    got = roi.compute_roi(report(spark, values={"monthly_volume": 120.0}), 25.0, 0.8, 1.5, 650.0).first()
    assert (got.economies_mensuelles, got.projection_annuelle, got.mois_retour_investissement) == (325.0, 3900.0, 2.0)
    assert got.assumptions[-1] == "implementation_cost=650.00"
    none = roi.compute_roi(report(spark, values={"manual_time_minutes": 1.0}), 25.0, 0.8, 1.5, 650.0).first()
    assert (none.economies_mensuelles, none.mois_retour_investissement) == (0.0, None)


@pytest.mark.parametrize(
    "kwargs, args, want",
    [
        ({}, (0.0,), "hourly_rate_not_positive"),
        ({}, (25.0, 1.1), "automation_rate_out_of_range"),
        ({}, (25.0, 1.0, -1.0), "residual_time_negative"),
        ({"levels": {"monthly_volume": "missing"}}, (25.0,), "roi_blocked"),
        ({"values": {"manual_time_minutes": -1.0}}, (25.0,), "manual_time_unusable"),
    ],
)
def test_savings_guards(spark, kwargs, args, want):
    got = roi.compute_roi(report(spark, **kwargs), *args).first()
    assert got.violation == want and got.economies_mensuelles is None and got.detail_calcul is None


def test_savings_contract(spark):
    df = roi.compute_roi(report(spark, values={"monthly_volume": 7.0}), 25.0, 0.8, 1.5)
    got = df.first()
    assert (got.economies_mensuelles, got.projection_annuelle) == (18.96, 227.5)
    assert roi.roi_violations(df).isEmpty()
    assert [r.rule for r in roi.roi_violations(df, tol=0.0).collect()] == ["annual_not_12_months"]
    broken = df.withColumn("economies_mensuelles", F.lit(-1.0)).withColumn("confidence", F.col("confidence").withField("roi_mode", F.lit("maybe")))
    assert sorted(r.rule for r in roi.roi_violations(broken).collect()) == [
        "annual_not_12_months", "economies_mensuelles_negative", "roi_mode_invalid",
    ]


def test_user_report_and_audit(spark):
    users = spark.createDataFrame(
        [("a", 100.0, 10.0, 50.0), ("b", 5.0, None, None)],
        "process_id string, monthly_volume double, manual_time_minutes double, waiting_time_minutes double",
    )
    df = mt.report_from_user(users)
    by = {r.process_id: r for r in df.collect()}
    assert by["a"].case_cycle_time_minutes.value == 60.0 and by["a"].activity_duration_minutes.confidence_level == "estimated"
    assert (by["a"].can_compute_partial_roi, by["b"].can_compute_partial_roi) == (True, False)
    audit = {r.process_id: r.warnings for r in time_rules.audit_time(df).collect()}
    assert audit == {
        "a": ["estimated_metrics", "partial_roi_only", "waiting_far_above_activity"],
        "b": ["missing_metrics", "roi_disabled"],
    }
    kinds = {r.process_id: r.precision for r in mt.precision(df).collect()}
    assert kinds == {"a": "approximate", "b": "partial"}


def test_telemetry(spark):
    runs = spark.createDataFrame(
        [("r", "one", 1.5, 100, 50, 999), ("r", "two", 2.0, 200, None, None), ("r", "three", 0.0, None, 100, None)],
        "run_id string, agent_name string, latency_seconds double, prompt_tokens long, completion_tokens long, total_tokens long",
    )
    got = telemetry_summary(runs).first()
    assert tuple(got) == ("r", 3.5, 300, 150, 450)
