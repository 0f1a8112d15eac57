"""Nearest vectors by vantage-point trees, one per shard.

The largest inner product becomes the smallest distance when every vector gets one more component
that makes all lengths equal; the triangle inequality then holds and can prune. Each leaf of a tree
carries, for every vantage point above it, the range of distances of its vectors. A query's distance
to a leaf is at least the gap between its own distance and that range; with ``relax`` the gap is
multiplied before it is held against the query's 20th distance so far, so that more is pruned. One
is exact. Leaves are visited from the least bound on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm import ship
from tracemill.session import checkpoint

SHARD = 4096  # vectors of a shard, about
LEAF = 256
BLOCK = 256  # queries that travel together
RELAX = 4.0


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[np.ndarray], list[list[tuple[int, float, float]]]]:
    """(vantage rows, leaves as row numbers, per leaf (vantage, least, most distance) of its path).

    Halves are cut by rank, so equal distances and copies cannot unbalance the tree. The vantage
    point of a node is the row farthest from the node's first row.
    """
    vantage: list[int] = []
    leaves: list[np.ndarray] = []
    paths: list[list[tuple[int, float, float]]] = []
    stack: list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]] = [(np.arange(len(points)), [])]
    while stack:
        rows, path = stack.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            paths.append([(v, float(d.min()), float(d.max())) for v, d in path])
            continue
        far = rows[np.argmax(((points[rows] - points[rows[0]]) ** 2).sum(1))]
        d = np.sqrt(((points[rows] - points[far]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        v = len(vantage)
        vantage.append(int(far))
        half = len(rows) // 2
        for part in (order[half:], order[:half]):
            stack.append((rows[part], [(u, e[part]) for u, e in path] + [(v, d[part])]))
    return np.array(vantage, dtype=np.int64), leaves, paths


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the components summed in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += q[..., j] * x[:, j]
    return total


def search(vectors: np.ndarray, tree: tuple, queries: np.ndarray, skip: np.ndarray, k: int, relax: float, top: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores): the ``k`` nearest found of each query and whatever ties with the last.

    ``skip`` is the row that a query must not find, or -1; ``top`` the square of the longest
    vector's length.
    """
    vantage, leaves, paths = tree
    own = (queries**2).sum(1) + top  # squared distance is own - 2 * product
    m, total = len(queries), len(leaves)
    low = np.zeros((m, total))
    if len(vantage):
        to = np.sqrt(np.maximum(own[:, None] - 2 * queries @ vectors[vantage].T, 0))
        # The vantage points are lifted points too; their lift meets the query's 0.
        for j, path in enumerate(paths):
            for v, least, most in path:
                np.maximum(low[:, j], np.maximum(least - to[:, v], to[:, v] - most), out=low[:, j])
    order = np.argsort(low, axis=1, kind="stable")
    best = np.full((m, k), -np.inf)
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(m)]
    slack = 1e-9 * (1 + np.sqrt(top * np.maximum(own - top, 0)))
    for rank in range(total):
        leaf_of = order[:, rank]
        gap = low[np.arange(m), leaf_of] * relax
        radius = np.sqrt(np.maximum(own - 2 * np.where(np.isfinite(best[:, -1]), best[:, -1], 0), 0))
        active = np.flatnonzero((gap <= radius + 1e-7) | np.isinf(best[:, -1]))
        for j in np.unique(leaf_of[active]):
            who, rows = active[leaf_of[active] == j], leaves[j]
            near = queries[who] @ vectors[rows].T
            near[skip[who][:, None] == rows[None, :]] = -np.inf
            keep = near >= np.maximum(best[who, -1] - slack[who], -1e300)[:, None]
            best[who] = -np.sort(-np.concatenate([best[who], near], axis=1), axis=1)[:, :k]
            at, col = np.nonzero(keep)
            cut = np.searchsorted(at, np.arange(len(who) + 1))
            for i, w in enumerate(who):
                if cut[i] < cut[i + 1]:
                    c = col[cut[i] : cut[i + 1]]
                    kept[w].append((rows[c], near[i, c]))
    for w in range(m):
        if kept[w]:
            rows = np.concatenate([r for r, _ in kept[w]])
            near = np.concatenate([s for _, s in kept[w]])
            rows = rows[near >= best[w, -1] - slack[w]]
            yield w, rows, exact_scores(queries[w], vectors[rows])


def _pack(tree: tuple) -> tuple[bytes, bytes, bytes, bytes]:
    vantage, leaves, paths = tree
    sizes = np.array([len(x) for x in leaves], dtype=np.int64)
    flat = np.array([(j, v, a, b) for j, p in enumerate(paths) for v, a, b in p], dtype=np.float64)
    return vantage.tobytes(), sizes.tobytes(), np.concatenate(leaves).astype(np.int64).tobytes(), flat.tobytes()


def _unpack(vantage: bytes, sizes: bytes, rows: bytes, flat: bytes) -> tuple:
    n = np.frombuffer(sizes, np.int64)
    leaves = np.split(np.frombuffer(rows, np.int64), np.cumsum(n)[:-1])
    paths: list[list[tuple[int, float, float]]] = [[] for _ in n]
    for j, v, a, b in np.frombuffer(flat, np.float64).reshape(-1, 4):
        paths[int(j)].append((int(v), a, b))
    return np.frombuffer(vantage, np.int64), leaves, paths


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part, in double precision; not null, not zero, all finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(fine)


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each vector once, with its ``keep`` smallest ids.

    A common vector is thinned in steps, by salts of its ids, so that no task meets all its copies.
    """
    rows = rows.dropDuplicates(["id", "v"])
    for salts in (32, 4, 1):
        w = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
        rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")
    return rows.groupBy("v").agg(F.collect_list("id").alias("ids"))


def nearest(vectors: DataFrame, is_query, k: int = 20, relax: float = RELAX, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every query, by inner product.

    ``is_query`` is a condition on the column "id". Every usable vector is indexed; vectors of one length in
    components are searched together. Copies of a vector are one point of the tree, which keeps the
    k + 1 smallest ids: with ties going to the smaller id, no other can be among k results. Rows with
    the same id and vector are one; an id with several vectors has the score of the nearest pair of them.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    points = checkpoint(_distinct(rows, k + 1).withColumn("dim", F.size("v")))
    stats = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"))
    stats = stats.withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    # One row per vector length in components; that is a property of the table, not of its size.
    placed = points.join(F.broadcast(stats.select("dim", "shards", "top")), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def index(g: pd.DataFrame) -> pd.DataFrame:
        v = np.array(g["v"].tolist(), dtype=np.float64)
        top = float(g["top"].iloc[0])
        lifted = np.column_stack([v, np.sqrt(np.maximum(top - (v**2).sum(1), 0))])
        tree = _pack(build(lifted))
        copies = [np.asarray(x, dtype=np.int64) for x in g["ids"]]
        counts = np.array([len(c) for c in copies], dtype=np.int64)
        return pd.DataFrame([(g["dim"].iloc[0], g["shard"].iloc[0], top, v.tobytes(), counts.tobytes(), np.concatenate(copies).tobytes(), *tree)])

    trees = placed.groupBy("dim", "shard").applyInPandas(
        index, "dim int, shard int, top double, x binary, n binary, ids binary, vantage binary, sizes binary, leaf_rows binary, ranges binary"
    )

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        v = np.array(g["v"].tolist(), dtype=np.float64)
        return pd.DataFrame([(g["dim"].iloc[0], v.tobytes(), g["id"].to_numpy(np.int64).tobytes())])

    asked = rows.filter(is_query).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))
    counted = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = (
        asked.join(F.broadcast(counted), "dim")
        .withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")))
        .groupBy("dim", "block").applyInPandas(gather, "dim int, qv binary, qid binary")
        .join(F.broadcast(stats.select("dim", "shards")), "dim")
        # The stated query set meets every shard, in blocks.
        .select("dim", "qv", "qid", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                r = {c: whole.column(c)[at].as_py() for c in whole.schema.names}
                x = np.frombuffer(r["x"], np.float64).reshape(-1, r["dim"])
                counts, ids = np.frombuffer(r["n"], np.int64), np.frombuffer(r["ids"], np.int64)
                start = np.concatenate([[0], np.cumsum(counts)])
                tree = _unpack(r["vantage"], r["sizes"], r["leaf_rows"], r["ranges"])
                q = np.frombuffer(r["qv"], np.float64).reshape(-1, r["dim"])
                qid = np.frombuffer(r["qid"], np.int64)
                # A point that is one row only must not be found by that row.
                single = np.flatnonzero(counts == 1)
                single = single[np.argsort(ids[start[single]], kind="stable")]
                names = ids[start[single]]
                place = np.minimum(np.searchsorted(names, qid), max(len(names) - 1, 0))
                skip = np.where(names[place] == qid, single[place], -1) if len(names) else np.full(len(qid), -1)
                out: list[tuple] = []
                for w, rows, score in search(x, tree, q, skip, k, relax, r["top"]):
                    me = int(qid[w])
                    spread = [(-s, i) for p, s in zip(rows.tolist(), score.tolist()) for i in ids[start[p] : start[p + 1]].tolist() if i != me]
                    out += [(me, i, -s) for s, i in sorted(spread)[:k]]
                if out:
                    a, b, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "id", "score"])

    found = trees.join(blocks, ["dim", "shard"]).mapInArrow(find, "query_id long, id long, score double")
    # Each shard gives k rows per query at most.
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
