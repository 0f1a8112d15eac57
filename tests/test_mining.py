import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.operators import mining as m
from tracemill.operators.columns import MissingColumns
from tracemill.operators.eventlog import duration_log, event_log, processes_without_rows
from tracemill.operators.median import exact_median
from tracemill.operators.sequence import along


def log(spark, rows):
    df = spark.createDataFrame(rows, "p string, c string, a string, t long, s long, n long")
    df = df.withColumns({"t": F.timestamp_seconds("t"), "s": F.timestamp_seconds("s")})
    return event_log(df, "c", "a", "t", "s", tiebreak="n", process=F.col("p"))


@pytest.fixture(scope="module")
def skewed(spark):
    """One case holds most events, many of them at the same moment."""
    rng = random.Random(3)
    rows, n = [], 0
    for case in range(40):
        size = 1500 if case == 0 else rng.randint(1, 6)
        for _ in range(size):
            n += 1
            t = rng.choice([500, rng.randint(0, 5000)])
            rows.append(("p1" if case % 3 else "p0", f"c{case}", rng.choice("abc"), t, t - rng.randint(-20, 60), n))
    return rows


def reference(rows):
    cases = defaultdict(list)
    for p, c, a, t, _, n in rows:
        cases[p, c].append((t, n, a))
    waits, edges, variants, cycles = defaultdict(list), Counter(), Counter(), defaultdict(list)
    for (p, c), events in cases.items():
        events.sort()
        cycles[p].append((events[-1][0] - events[0][0]) / 60)
        variants[p, tuple(e[2] for e in events)] += 1
        for x, y in zip(events, events[1:]):
            waits[p].append((y[0] - x[0]) / 60)
            edges[p, x[2], y[2]] += 1
    return waits, edges, variants, cycles


@pytest.mark.parametrize("limit", [10**6, 50])
def test_case_order_measures(spark, skewed, limit):
    waits, edges, variants, cycles = reference(skewed)
    df = log(spark, skewed)
    got = {r.process_id: (r.waiting_minutes, r.pairs) for r in m.waiting_time(df, limit).collect()}
    assert got == {p: (round(statistics.median(w), 2), len(w)) for p, w in waits.items()}
    found = {(r.process_id, r.activity, r.next_activity): r.weight for r in m.directly_follows(df, limit).collect()}
    assert found == edges
    seen = Counter()
    for r in m.variants(df, limit).collect():
        seen[r.process_id, r.length] += r.cases
        assert (r.variant is None) == (r.length > limit)
    want = Counter()
    for (p, v), n in variants.items():
        want[p, len(v)] += n
    assert seen == want
    measures = {r.process_id: r for r in m.process_measures(df, limit, limit).collect()}
    for p in cycles:
        assert measures[p].cycle_minutes == round(statistics.median(cycles[p]), 2)
        assert measures[p].waiting_minutes == got[p][0]
        assert measures[p].variants_count == sum(1 for q, _ in variants if q == p)
        assert measures[p].dfg_edges_count == sum(1 for q, _, _ in edges if q == p)


def test_positions_in_an_oversized_group(spark):
    rng = random.Random(9)
    keys = [(0, rng.choice([7, rng.randint(0, 10**12)]), i) for i in range(3000)] + [(1, 5, 1), (1, 2, 2)]
    df = spark.createDataFrame(keys, "g int, x long, y long")
    out = along(df, ["g"], ["x", "y"], ["x", "y"], lag={"before": "y"}, lead={"after": "y"}, position="n", max_rows=100)
    rows = sorted(tuple(r) for r in out.select("g", "n", "x", "y", "before", "after").collect())
    ordered = sorted(keys)
    want = []
    for g in (0, 1):
        own = [k for k in ordered if k[0] == g]
        for i, (_, x, y) in enumerate(own):
            want.append((g, i + 1, x, y, own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None))
    assert rows == want


def test_exact_median(spark):
    rng = random.Random(11)
    groups = {
        "even": [1.0, 2.0, 4.0, 10.0], "one": [-3.5], "same": [7.0] * 9, "zero": [0.0, -0.0, 0.0],
        "wide": [rng.uniform(-1e9, 1e9) for _ in range(501)], "close": [1e6 + rng.random() * 1e-6 for _ in range(400)],
        "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(300)] + [2.0**k for k in range(-20, 20)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("none", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r["median"], r.n) for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: (statistics.median(vs), len(vs)) for k, vs in groups.items()}


def test_volume_and_durations(spark):
    rows = [("p", "a", "x", 0, 0, 1), ("p", "a", "y", 600, 0, 2), ("p", "b", "x", 86400 * 9 + 5, 86400 * 9, 3)]
    df = log(spark, rows)
    assert m.monthly_volume(df).first().asDict() == {"process_id": "p", "cases": 2, "days": 10, "monthly_volume": 6.0}
    # means: x (0 + 5 s) / 2, y 600 s
    assert m.activity_duration(df).first().activity_minutes == round((2.5 / 60 + 10) / 2, 2)
    ends = {(r.case_id, r.start_activity, r.end_activity) for r in m.case_ends(df).collect()}
    assert ends == {("a", "x", "y"), ("b", "x", "x")}


def test_row_duration_falls_back_to_end(spark):
    df = spark.createDataFrame([("a", "x", 100, 160, 400), ("a", "y", 100, 130, 250)], "c string, a string, t long, s long, e long")
    df = df.withColumns({k: F.timestamp_seconds(k) for k in "tse"})
    got = m.row_duration(event_log(df, "c", "a", "t", "s", "e")).first()
    assert (got.row_minutes, got.basis) == (3.0, "start-end")


def test_negative_means_are_dropped_per_activity(spark):
    rows = [("p", "a", "x", 0, 6000, 1), ("p", "a", "x", 60, 0, 2), ("p", "a", "y", 120, 60, 3)]
    assert m.activity_duration(log(spark, rows)).first().activity_minutes == 1.0
    assert m.row_duration(log(spark, rows)).first().row_minutes == 1.0


def test_incomplete_rows(spark):
    df = spark.createDataFrame([("a", "x", "2024-01-01"), ("a", None, "2024-01-01"), ("b", "x", "?")], "c string, a string, t string")
    assert event_log(df, "c", "a", "t").count() == 1
    with pytest.raises(MissingColumns, match="case_id"):
        event_log(df)
    d = spark.createDataFrame([("p", "a", "x", "5"), ("q", "a", "x", "?")], "process_id string, c string, a string, d string")
    durations = duration_log(d, "c", "a", "d", process=F.col("process_id"))
    assert [r.process_id for r in processes_without_rows(d, durations).collect()] == ["q"]
    assert m.duration_summary(durations).first().median_minutes == 5.0
