"""Splittable reading of JSON documents against the reader of whole ones."""

import json
import random

import pytest

from tracemill.sources import documents, large

TEXTS = ["plain", 'quote " in', "back\\slash\\\\", "brace } { ] [ ,", "é日本", "", 'end\\"', "line\nbreak\t", "\\u007d"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(TEXTS)
    if kind == 1:
        return rng.choice([1, 2.5, -3, 10**15, True, False, None])
    if kind < 4:
        return "".join(rng.choices('ab"\\}{[],: ', k=rng.randrange(30)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def record(rng, i):
    return {"id": i, "t": rng.choice(TEXTS), **{f"f{j}": value(rng) for j in range(rng.randrange(4))}}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def both(spark, path):
    want = documents.extract_records(documents.read_documents(spark, path))
    got = large.read_records(spark, path)
    key = lambda df: sorted(((r.path, r.record_no, r.record) for r in df.collect()), key=repr)
    return key(got), key(want)


def dump(rng, data):
    style = rng.choice([{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
    return rng.choice(["", " ", "\n"]) + json.dumps(data, **style) + rng.choice(["", "\n", "  "])


@pytest.mark.parametrize("seed", range(6))
def test_random_documents_equal_the_whole_reader(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    for n in range(6):
        records = [record(rng, i) for i in range(rng.choice([1, 5, 60]))]
        others = {f"m{i}": value(rng) for i in range(rng.randrange(4))}
        late = {f"z{i}": value(rng) for i in range(rng.randrange(3))}
        data = records if n % 2 else {**others, "rows": records, **late, "more": [{"no": 1}]}
        (tmp_path / f"d{n}.json").write_text(dump(rng, data), encoding="utf-8")
    got, want = both(spark, str(tmp_path))
    assert got == want and len(got) >= 6


def test_shapes_without_a_list_of_objects(spark, small_splits, tmp_path):
    shapes = ["[]", " [ ] ", "{}", '{"a": []}', '{"a": [1, {"b": 2}], "c": {"d": [{"e": 1}]}}', '[1, "x}", null, [2], {"a": [{"b": 1}]}]', '{"a": "[{"}', '{"a": [[{"x": 1}]], "b": [ \n {"y": 2} ]}']
    for i, text in enumerate(shapes):
        (tmp_path / f"s{i}.json").write_text(text)
    got, want = both(spark, str(tmp_path))
    assert got == want and len(want) == 6


def test_one_long_record_spans_splits(spark, small_splits, tmp_path):
    data = [{"a": 1}, {"b": "x" * 5000 + '"}{' * 900, "c": [{"d": i} for i in range(300)]}, {"e": 2}]
    (tmp_path / "one.json").write_text(json.dumps(data))
    got, want = both(spark, str(tmp_path))
    assert got == want and len(got) == 3


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "array.json")
    with open(path, "w") as f:
        f.write("[")
        for i in range(60_000):
            f.write(("," if i else "") + json.dumps({"id": i, "name": f"row {i}", "part": {"x": i % 7, "note": 'a "}" b'}}))
        f.write("]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        table = documents.load_table(spark, path, split=True)
        assert large._fragments(spark, path).rdd.getNumPartitions() >= 8
        assert tuple(table.selectExpr("count(*)", "sum(id)", "sum(record_no)", "sum(part.x)", "max(name)").first()) == (
            60_000, 1_799_970_000, 1_799_970_000, sum(i % 7 for i in range(60_000)), "row 9999",
        )
        upload = documents.read_upload(spark, path, split=True)
        assert sorted(upload.columns) == ["id", "name", "part"] and upload.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
