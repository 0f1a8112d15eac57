import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalars as s
from tracemill.functions.vectors import cosine_distance


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("_")])
    return row.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, want",
    [("72%", 72.0), (" 72.5 % ", 72.5), ("100%", 100.0), ("101%", None), ("-1%", None), ("1,5%", None), ("%", None), (None, None)],
)
def test_percent(spark, text, want):
    assert one(spark, s.parse_percent(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "text, want",
    [("Hello World", "hello_world"), ("N1 — étape@critique!", "n1____tape_critique_"), ("", ""), ("my-workflow-dag", "my_workflow_dag")],
)
def test_sanitize(spark, text, want):
    assert one(spark, s.sanitize_id(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [(None, ""), ("", ""), ("x" * 40, "x" * 40), ("y" * 41, "y" * 38 + ".."), ("z" * 50, "z" * 38 + "..")])
def test_short_label(spark, text, want):
    assert one(spark, s.short_label(F.lit(text).cast("string"))) == want


def test_blank_words_and_sizes(spark):
    assert [one(spark, s.non_blank(F.lit(t).cast("string"))) for t in (None, "", " \t\n", " a ")] == [False, False, False, True]
    assert [one(spark, s.word_count(F.lit(t).cast("string"))) for t in (None, "  ", "a", " one two\tthree\n")] == [0, 0, 1, 3]
    assert [one(spark, s.min_cluster_size(F.lit(n))) for n in (0, 1, 2, 20, 100, 1000)] == [2, 2, 2, 4, 6, 10]


def test_times(spark):
    minutes = s.minutes_between(F.lit("2024-01-15 09:03").cast("timestamp"), F.lit("2024-01-15 11:03").cast("timestamp"))
    assert one(spark, minutes) == 120.0
    for end, days in (("2024-01-16 09:02", 0), ("2024-01-16 09:03", 1), ("2024-01-15 09:00", -1)):
        span = s.whole_days_between(F.lit("2024-01-15 09:03").cast("timestamp"), F.lit(end).cast("timestamp"))
        assert one(spark, span) == days
    df = spark.createDataFrame([("2024-01-15 08:12", 1705306320 * 10**9), ("later", None)], "a string, n long")
    got = df.select(
        F.unix_seconds(s.as_timestamp("a", df.schema["a"].dataType)), F.unix_seconds(s.as_timestamp("n", df.schema["n"].dataType))
    ).collect()
    assert [tuple(r) for r in got] == [(1705306320, 1705306320), (None, None)]


def test_rounding_equals_exact_binary_rounding(spark):
    rng = random.Random(5)
    values = [2.675, -2.675, 0.125, 0.375, 1.005, 527.175, 0.005, -0.125, 0.0, 1e15, 1234567.885]
    values += [rng.randint(-(10**7), 10**7) / 1000 for _ in range(4000)] + [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", s.round_to("x").alias("two"), s.round_to("x", 3).alias("three")).collect():
        assert (row.two, row.three) == (round(row.x, 2), round(row.x, 3))


def test_cosine_distance(spark):
    def d(a, b):
        return one(spark, cosine_distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))

    assert d([1.0, 0.0], [0.0, 2.0]) == pytest.approx(1.0)
    assert d([1.0, 1.0], [2.0, 2.0]) == pytest.approx(0.0)
    assert d([0.0, 0.0], [1.0, 2.0]) == pytest.approx(1.0)
