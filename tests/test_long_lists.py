"""Variants and step lists beyond the length that one row holds."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracemill.operators import mining, transform


def log(spark, cases):
    rows = [("p" if c % 2 else "q", f"c{c:03}", a, i, 0) for c, path in cases.items() for i, a in enumerate(path)]
    df = spark.createDataFrame(rows, "process_id string, case_id string, activity string, at int, tiebreak long")
    return df.select("process_id", "case_id", "activity", F.timestamp_seconds("at").alias("timestamp"), "tiebreak")


def test_long_variants_are_equal_only_if_every_event_is(spark):
    rng = random.Random(2)
    base = [rng.choice("ab") for _ in range(130)]
    cases = {}
    for c in range(14):
        path = list(base)
        if c >= 8:  # one event differs, anywhere; or the order of two
            at = rng.randrange(len(path) - 1)
            path[at : at + 2] = ["z", path[at + 1]] if c % 3 else path[at : at + 2][::-1]
        cases[c] = path[: 129 if c in (6, 7) else 130]
    cases[14] = ["a", "b"]
    want = Counter(("p" if c % 2 else "q", tuple(p)) for c, p in cases.items())
    for limit in (4, 50):  # pieces of pieces of pieces, and pieces
        found = mining.variants(log(spark, cases), limit).collect()
        example = {(p, tuple(path)): min(f"c{c:03}" for c, q in cases.items() if tuple(q) == path and ("p" if c % 2 else "q") == p) for p, path in want}
        assert {(r.process_id, r.example_case): (r.length, r.cases) for r in found} == {(p, example[p, v]): (len(v), n) for (p, v), n in want.items()}
        parts = defaultdict(list)
        for r in mining.variant_parts(log(spark, cases), limit).orderBy("part").collect():
            assert len(r.activities) <= limit
            parts[r.process_id, r.example_case] += r.activities
        assert {k: tuple(v) for k, v in parts.items()} == {(p, example[p, v]): v for p, v in want}


def test_beyond_a_hundred_thousand_events_equality_is_exact(spark):
    n = mining.MAX_PATH_EVENTS + 50_000
    i = F.col("id")
    events = spark.range(3 * n).select(
        F.lit("p").alias("process_id"), F.floor(i / n).cast("string").alias("case_id"),
        # The last case differs in one event.
        F.when(i == 3 * n - 7, "odd").otherwise(((i % n) % 13).cast("string")).alias("activity"),
        F.timestamp_seconds(i % n).alias("timestamp"), F.lit(0).cast("long").alias("tiebreak"),
    )
    assert sorted((r.length, r.cases, r.example_case) for r in mining.variants(events).collect()) == [(n, 1, "2"), (n, 2, "0")]
    parts = mining.variant_parts(events).select("example_case", "part", F.size("activities").alias("n")).collect()
    assert sorted(tuple(r) for r in parts) == [(c, p, m) for c in "02" for p, m in ((0, 100_000), (1, 50_000))]


def test_list_parts_are_sorted_and_whole(spark):
    rng = random.Random(5)
    rows = [(f"w{w}", f"{rng.choice(['S', 'step', 'stepping', 'é'])}{rng.randrange(400)}", rng.choice(transform.CLASSES)) for w in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "workflow_id string, step_id string, class string")
    got = defaultdict(list)
    for r in transform.list_parts(df, 7).orderBy("part").collect():
        assert len(r.step_ids) <= 7
        got[r.workflow_id, r["class"]] += r.step_ids
    want = defaultdict(set)
    for w, s, c in rows:
        want[w, c].add(s)
    assert got == {k: sorted(v, key=str.encode) for k, v in want.items()}
