import random

import numpy as np
from pyspark.sql import functions as F

from tracemill.operators import neighbours as nb
from tracemill.operators.components import connected_components, local_forest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, count: int, features: int = 50):
    """Counts and scales of groups of near vectors; every fifth one shares a node with the one before."""
    rng = np.random.default_rng(3)
    rows, x, scale = [], np.zeros((count, features)), rng.uniform(0.5, 3.0, features)
    base = rng.integers(0, 4, (6, features)) * (rng.random((6, features)) < 0.3)
    for k in range(count):
        v = base[k % 6] + (rng.random(features) < 0.04)
        v[k % features] += 1
        r = np.flatnonzero(v).astype(np.int32)
        x[k] = v * scale
        rows.append((k - 1 if k % 5 == 4 else k, k % 3 + 1, r.tobytes(), v[r].astype(np.float32).tobytes()))
    df = spark.createDataFrame([(a, b, bytearray(c), bytearray(d)) for a, b, c, d in rows], "node long, weight long, ranks binary, counts binary")
    return df, rows, x / np.linalg.norm(x, axis=1, keepdims=True), spark.sparkContext.broadcast(scale)


def test_links_are_whole_and_no_pair_is_shuffled(spark):
    df, rows, unit, scale = points(spark, 90)
    for eps in (0.4, 0.8, 1.2):
        want = {}
        near = unit @ unit.T >= nb.required_cosine(eps) - 1e-9
        for i in range(90):
            for j in range(i + 1, 90):
                a, b = rows[i], rows[j]
                if near[i, j] and a[0] != b[0]:
                    (a, b) = (a, b) if a[0] < b[0] else (b, a)
                    weight, back = want.get((a[0], b[0]), (0, 0))
                    want[a[0], b[0]] = (weight + b[1], back + a[1])
        for block_rows in (1000, 7):
            links = nb.sparse_links(df, eps, scale, block_rows)
            assert "Exchange" not in plan(links)
            got = links.groupBy("src", "dst").agg(F.sum("weight").alias("w"), F.sum("back").alias("b")).collect()
            assert {(r.src, r.dst): (r.w, r.b) for r in got} == want and want


def test_forest_has_fewer_edges_than_nodes(spark):
    edges = [(i, j) for g in range(3) for i in range(g * 100, g * 100 + 80) for j in range(i + 1, g * 100 + 80)]
    random.Random(5).shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long")
    ids = df.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    light = local_forest(df.coalesce(1))
    assert light.count() == 3 * 79
    assert {(r.id, r.component) for r in connected_components(ids, light).collect()} == {(g * 100 + i, g * 100) for g in range(3) for i in range(80)}
