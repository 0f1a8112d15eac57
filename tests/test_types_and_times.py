"""Types of JSON records and times in many forms."""

import datetime
import json
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import times
from tracemill.operators.eventlog import event_log
from tracemill.operators.normalize import normalize
from tracemill.plans.analyses import analyse_time
from tracemill.sources import documents as docs
from tracemill.sources import schema as sc


def records(spark, rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "record_no int, record string")


def kind_of(*values):
    facts = {}
    for v in values:
        sc.gather(v if isinstance(v, str) else json.dumps(v), facts)
    return sc.record_type(facts).simpleString()


def test_awkward_names_and_long_numbers_come_back_exact(spark):
    big = 1234567890123456789012345
    rows = [
        {"VARIANT": "a", "VOID": 1, "a.b": 2, "STRING": [{"OBJECT<": 3}], "Name": "x", "name": "y", "NAME": "z", "big": big, "`q`": True},
        {"VARIANT": None, "big": 7, "Name": "w", "in": {"Ab": 1, "aB": 2}, "name_2": 5},
    ]
    table = docs.records_table(records(spark, rows))
    assert dict(table.dtypes)["big"] == "decimal(25,0)" and dict(table.dtypes)["VOID"] == "bigint"
    one, two = table.orderBy("record_no").collect()
    got = one.asDict(recursive=True)
    assert got["VARIANT"] == "a" and got["VOID"] == 1 and got["a.b"] == 2 and got["big"] == Decimal(big) and got["`q`"] is True
    assert got["STRING"] == [{"OBJECT<": 3}]
    names = [c for c in table.columns if c.lower().startswith("name")]
    assert len({c.lower() for c in names}) == 4
    assert sorted(str(got[c]) for c in names) == ["None", "x", "y", "z"]
    assert two["in"].asDict() == {"Ab": 1, "aB_2": 2} or two["in"].asDict() == {"Ab": 2, "aB_2": 1} or set(two["in"].asDict().values()) == {1, 2}
    assert two.big == 7 and two.VARIANT is None


@pytest.mark.parametrize("values, want", [
    ([{"a": 1}, {"a": None}], "struct<a:bigint>"),
    ([{"a": None}], "struct<a:string>"),
    ([{"a": True}, {"a": 1}], "struct<a:string>"),
    ([{"a": 1}, {"a": 2.5}], "struct<a:double>"),
    ([{"a": 2**63 - 1}], "struct<a:bigint>"),
    ([{"a": -(2**63)}], "struct<a:bigint>"),
    ([{"a": 2**63}], "struct<a:decimal(19,0)>"),
    ([{"a": 2**63}, {"a": 1.5}], "struct<a:double>"),
    ([{"a": 10**38}], "struct<a:string>"),
    ([{"a": []}, {"a": [1]}], "struct<a:array<bigint>>"),
    ([{"a": []}], "struct<a:array<string>>"),
    ([{"a": [1, "x"]}], "struct<a:array<string>>"),
    ([{"a": {}}], "struct<a:string>"),
    ([{"a": {"b": 1}}, {"a": {"c": [{"d": 1.0}]}}], "struct<a:struct<b:bigint,c:array<struct<d:double>>>>"),
    ([{"a": {"b": 1}}, {"a": 3}], "struct<a:string>"),
    (["no json", {"a": "x"}, "{"], "struct<a:string>"),
    (['{"a": NaN}', '{"a": 1e5}'], "struct<a:double>"),
])
def test_types_of_values(values, want):
    assert kind_of(*values) == want
    assert kind_of(*reversed(values)) == want


def test_facts_of_parts_add_up(spark):
    rows = [{"a": i} if i % 3 else {"a": float(i), "b": [{"c": None}]} for i in range(40)]
    df = records(spark, rows)
    assert sc.collect_facts(sc.paths(df.repartition(7))) == sc.collect_facts(sc.paths(df.coalesce(1)))


def test_mixed_values_keep_their_text(spark):
    rows = [{"a": {"b": 1}}, {"a": 3}, {"a": "x"}, {"a": [1, 2]}]
    assert [r.a for r in docs.records_table(records(spark, rows)).orderBy("record_no").collect()] == ['{"b":1}', "3", "x", "[1,2]"]


def test_scalars_in_the_list_are_null_rows_and_none_at_all_is_an_error(spark):
    table = docs.records_table(records(spark, [{"a": 1}, "5", "null"]))
    assert [r.a for r in table.orderBy("record_no").collect()] == [1, None, None]
    with pytest.raises(docs.NoRecords):
        docs.records_table(records(spark, ["5", "[1]"]))


# --- times

CLEAR = [
    "2024-01-05 14:30", "2024-01-05T14:30:15", "2024-01-05", "2024/01/05 14:30:00", "2024/1/5", "20240105", "20240105 143000",
    "Jan 5, 2024", "January 5, 2024 14:30", "5 Jan 2024", "5 January 2024 2:30 PM", "5-Jan-2024", " 2024-01-05  14:30 ", "Jan 5 2024",
]


def read(spark, values, day_first=False):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", times.text_time(F.col("t"), day_first).cast("timestamp_ntz").alias("x")).orderBy("i").collect()]


def test_forms_with_one_reading_equal_the_usual_coercion(spark):
    for text, got in zip(CLEAR, read(spark, CLEAR)):
        assert got == pd.to_datetime(text.strip()).to_pydatetime(), text


def test_what_is_no_time_stays_null(spark):
    assert read(spark, ["", "  ", "soon", "2024-13-01", "99/99/2024", "12345678901", "202401051", "5/2024", None]) == [None] * 9


@pytest.mark.parametrize("text, day_first, want", [
    ("05/01/2024 14:30", True, (2024, 1, 5, 14, 30)), ("05/01/2024 14:30", False, (2024, 5, 1, 14, 30)),
    ("5.1.2024", True, (2024, 1, 5)), ("5-1-24 9:05:07", False, (2024, 5, 1, 9, 5, 7)), ("31/12/2023 11:59 PM", True, (2023, 12, 31, 23, 59)),
    ("12/31/2023, 08:00", False, (2023, 12, 31, 8, 0)),
])
def test_two_readings(spark, text, day_first, want):
    assert read(spark, [text], day_first) == [datetime.datetime(*want)]


def test_order_is_a_vote_of_the_column(spark):
    rows = [("05/01/2024", "05/01/2024", "1/5/2024", "2024-01-05"), ("13/01/2024", "01/13/2024", "2/6/2024", "bad"), ("06/02/2024", "02/06/2024", "3/3/2024", None)]
    df = spark.createDataFrame(rows, "d string, m string, both string, iso string").withColumn("typed", F.current_timestamp())
    forms = times.time_forms(df, ["d", "m", "both", "iso", "typed"])
    assert {c: f.day_first for c, f in forms.items()} == {"d": True, "m": False, "both": False, "iso": False}
    assert forms["both"].doubtful == 2 and forms["d"].doubtful == 0
    assert (forms["iso"].values, forms["iso"].unread) == (2, 1) and len(forms["iso"].warnings("iso")) == 1 and forms["d"].unread == 0
    assert forms["both"].warnings("both")[0].startswith("2 values of both")


def test_normaliser_and_log_use_the_vote(spark):
    rows = [("c", "a", "25/01/2024 10:00", "25/01/2024 11:00"), ("c", "b", "02/02/2024 10:00", "02/02/2024 10:30")]
    df = spark.createDataFrame(rows, "case_id string, action string, created string, resolved string")
    assert sorted(r.duration_minutes for r in normalize(df).collect()) == [30.0, 60.0]
    log = event_log(df.withColumnsRenamed({"action": "activity"}), timestamp="created", end="resolved").orderBy("timestamp").collect()
    assert [r.timestamp.month for r in log] == [1, 2] and log[1].end_timestamp.day == 2


def test_unread_and_doubtful_values_are_warned_of(spark):
    df = spark.createDataFrame([("c", "a", "05/01/2024"), ("c", "b", "06/01/2024"), ("c", "b", "never")], "case_id string, activity string, timestamp string")
    told = analyse_time(df, 30.0).context.warnings
    assert any("1 of 3 values of timestamp" in w for w in told) and any("2 values of timestamp read" in w for w in told)


def test_long_type_of_the_schema_is_spark_s():
    assert isinstance(sc.record_type({(): (sc.OBJECT, 0), ("a",): (sc.LONG, 3)})["a"].dataType, T.LongType)
