"""Files that steps keep: as many as their rows need, whatever the number of shuffle partitions is."""

from __future__ import annotations

from pathlib import Path

import pytest

from tracemill.llm import minhash
from tracemill.operators.components import connected_components
from tracemill.session import checkpoint_dir

MANY = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _texts() -> list[tuple[int, str | None]]:
    base = [[f"w{g}x{i}" for i in range(120)] for g in range(12)]
    rows = [(g, " ".join(w)) for g, w in enumerate(base)]
    rows += [(100 + 10 * g + k, " ".join([*w[:-k], *(f"n{g}y{k}z{i}" for i in range(k))])) for g, w in enumerate(base) for k in (1, 2, 3)]
    return [*rows, (1000, rows[0][1]), (1001, None)]


def _files(root: Path) -> dict[str, int]:
    """Part files by folder."""
    found: dict[str, int] = {}
    for p in root.rglob("part-*"):
        found[str(p.parent)] = found.get(str(p.parent), 0) + 1
    return found


def test_steps_keep_few_files(spark, many_partitions):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string").coalesce(1)  # sketches are as many as the input's partitions
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = _files(root)
    found = minhash.near_duplicates(docs)
    rows = {r.doc_id: r.class_id for r in found.collect()}
    made = {k: v for k, v in _files(root).items() if k not in before}
    assert len(made) >= 10 and max(made.values()) == 1
    assert found.rdd.getNumPartitions() == 1
    assert minhash.deduplicate(docs).rdd.getNumPartitions() == 1
    assert rows == {i: (i if i < 12 else 0 if i == 1000 else 1001 if i == 1001 else (i - 100) // 10) for i, _ in _texts()}


def test_files_grow_with_rows(spark, many_partitions, monkeypatch):
    few = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(_texts(), "doc_id long, text string")).select("doc_id", "class_id").collect()}
    monkeypatch.setattr(minhash, "ROWS_A_FILE", 10)
    monkeypatch.setattr(minhash, "TEXTS_A_FILE", 10)
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = _files(root)
    found = minhash.near_duplicates(spark.createDataFrame(_texts(), "doc_id long, text string"))
    made = {k: v for k, v in _files(root).items() if k not in before and "rdd-" in k}
    assert max(made.values()) == 5
    assert {tuple(r) for r in found.select("doc_id", "class_id").collect()} == few


def test_rounds_of_components_keep_few_files(spark, many_partitions):
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = _files(root)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "u long, v long")
    rows = connected_components(spark.range(61), edges, 60).collect()
    assert {r.id: r.component for r in rows} == {i: i // 20 * 20 for i in range(61)}
    made = {k: v for k, v in _files(root).items() if k not in before}
    assert made and max(made.values()) == 1
