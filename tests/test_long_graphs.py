"""Cycles and reachability: rounds on long graphs, and random graphs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import graph


def closure(edges):
    reach = {}
    for w, a, b in edges:
        reach.setdefault(w, {}).setdefault(a, set()).add(b)
    out = {}
    for w, step in reach.items():
        for a in step:
            seen, stack = set(), list(step[a])
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack.extend(step.get(x, ()))
            out[w, a] = seen
    return out


@pytest.fixture
def rounds(monkeypatch):
    seen = []
    plain = graph.checkpoint

    def counted(df):
        seen.append(1)
        return plain(df)

    monkeypatch.setattr(graph, "checkpoint", counted)
    return seen


def random_edges(seed, workflows=60):
    rng = random.Random(seed)
    out = []
    for w in range(workflows):
        n = rng.randrange(2, 14)
        for _ in range(rng.randrange(1, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            if rng.random() < 0.75:
                a, b = min(a, b), max(a, b) + (a == b)
            out.append((f"w{w}", str(a), str(b)))
    return out


def test_cycles_of_random_graphs(spark):
    edges = random_edges(3)
    reach = closure(edges)
    want = {w for (w, a), seen in reach.items() if a in seen}
    got = [r.workflow_id for r in graph.cyclic_workflows(spark.createDataFrame(edges, "workflow_id string, de string, vers string")).collect()]
    assert sorted(got) == sorted(want) and 5 < len(want) < 55


@pytest.mark.parametrize("plain", [0, 2])
def test_reach_of_random_graphs(spark, plain):
    edges = random_edges(7)
    reach = closure(edges)
    sources = [(f"w{w}", s) for w in range(60) for s in ("0", "3")]
    want = set(sources) | {(w, x) for w, s in sources for x in reach.get((w, s), ())}
    df = spark.createDataFrame(edges, "workflow_id string, de string, vers string")
    got = [(r.workflow_id, r.id) for r in graph.reachable(df, spark.createDataFrame(sources, "workflow_id string, id string"), plain).collect()]
    assert sorted(got) == sorted(want)


LENGTH = 100_000


def chain(spark, *more):
    i = F.col("id")
    links = spark.range(LENGTH - 1).select(F.lit("w").alias("workflow_id"), i.cast("string").alias("de"), (i + 1).cast("string").alias("vers"))
    return links.unionByName(spark.createDataFrame([("w", str(a), str(b)) for a, b in more], links.schema)) if more else links


def test_a_long_chain_is_acyclic_within_forty_rounds(spark, rounds):
    assert graph.cyclic_workflows(chain(spark)).isEmpty() and len(rounds) <= 40


def test_a_long_cycle_behind_a_chain_is_found_within_forty_rounds(spark, rounds):
    assert graph.cyclic_workflows(chain(spark, (LENGTH - 1, LENGTH // 2))).count() == 1 and len(rounds) <= 40


def test_a_long_chain_is_reached_within_forty_rounds(spark, rounds):
    start = spark.createDataFrame([("w", "10")], "workflow_id string, id string")
    # A second circle that nothing enters is not reached.
    edges = chain(spark, *[(-i, -(i % 50) - 1) for i in range(1, 51)])
    assert graph.reachable(edges, start).count() == LENGTH - 10 and len(rounds) <= 40


@pytest.mark.parametrize("row_edges", [0, 4, 1_000])
def test_cycles_of_small_workflows_need_no_rounds(spark, monkeypatch, row_edges):
    """Paths of two lengths, of which every third is closed; rounds are for workflows above ``row_edges``."""
    edges = [(f"w{w}", i, i + 1) for w in range(60) for i in range(3 + 3 * (w % 2))]
    edges += [(f"w{w}", 1, 0) for w in range(0, 60, 3)] + [("self", 5, 5), ("open", 1, 2), ("none", None, 2), ("none", 2, None)]
    written = []
    monkeypatch.setattr(graph, "checkpoint", lambda df, f=graph.checkpoint: written.append(1) or f(df))
    df = spark.createDataFrame(edges, "workflow_id string, de long, vers long")
    found = sorted(r.workflow_id for r in graph.cyclic_workflows(df, row_edges).collect())
    assert found == sorted([f"w{w}" for w in range(0, 60, 3)] + ["self"])
    assert row_edges < 1_000 or len(written) == 2
