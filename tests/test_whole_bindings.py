"""Bindings that once ran on a part of their tables, on rows made here."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from oracle import difference

import workload

workload.load()
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Customers 1, 2 and 4; an order that is neither urgent nor large for each of 1 and 2, and its items."""
    d = str(tmp_path_factory.mktemp("tables"))
    later = [START + dt.timedelta(days=i) for i in range(30)]
    rows = {
        "customer": ([(k, 100.0) for k in (1, 2, 4)], "c_custkey long, c_acctbal double"),
        "orders": ([(k * 10, k, "5-LOW", 100.0, START) for k in (1, 2)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, o_orderdate timestamp"),
        "lineitem": ([(k * 10, n, "A", "F", later[20 + n]) for k in (1, 2) for n in (1, 2)], "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "events": ([(i, 7, "view", later[i], 1.0) for i in range(3)], "event_id long, user_id long, event_type string, ts timestamp, value double"),
        "supplier": ([(1,)], "s_suppkey long"),
        "nation": ([(1,)], "n_nationkey long"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def con(tables):
    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}/*.parquet'")
    return con


@pytest.mark.parametrize(("name", "column", "found"), [
    ("u5_empty_transformations", "workflow_id", [4]),
    ("v1_time_violations", "rule", ["activity_above_cycle", "manual_above_cycle"]),
    ("j7_uncovered", "c_custkey", [4]),
])
def test_whole_tables(spark, tables, con, name, column, found):
    rows = workload.QUERIES[name](spark, tables)
    assert sorted(r[column] for r in rows.collect()) == found
    assert difference(rows, con, workload.SQL[name]) is None
