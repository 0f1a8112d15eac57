"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target of words. It is taken whole as often as that fits; for the remaining
budget its documents are counted by exact size, a proportional share of each size is taken, and a
bounded-knapsack dynamic program over the sizes that are left closes the gap. Which documents of a
size are taken is decided by a seeded hash. Only size counts leave the documents' tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracemill.llm import column, ship
from tracemill.session import broadcast_if_small, checkpoint

DP_WORDS = 1 << 15  # the largest gap that the dynamic program closes
BUCKETS = 256  # of the seeded hash
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    words = F.size(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+"))
    return F.when(F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), words).otherwise(0).cast("long")


def fill_targets(sizes: list[int], weights: list[float], budget: float, most: float = 2.0) -> list[float]:
    """Share ``budget`` by weight; a share over ``most`` times its size gives its excess to the rest."""
    target = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), budget
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(most * sizes[i] for i in over)
        open_ -= set(over)
    return target


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, max_sources: int = 100_000) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources, null last, in code point order take the weights in turn. A mixture is set per source,
    so their table is read by the driver; more than ``max_sources`` are refused.
    """
    rows = totals.select("source", "source_size").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in rows]
    goal = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), most)
    schema = T.StructType([totals.schema["source"], T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    return totals.sparkSession.createDataFrame([(r.source, r.source_size, t) for r, t in zip(rows, goal)], schema)


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size (above 0) to take so that their words come near ``budget``.

    A floor share of each size, then whole documents, largest first, down to a gap of at most
    ``DP_WORDS``, which a bounded knapsack over the rest fills as far as sizes allow.
    """
    total = sum(s * c for s, c in counts.items())
    if budget >= total:
        return dict(counts)
    take = {s: c * budget // total for s, c in counts.items()}
    gap = budget - sum(s * k for s, k in take.items())
    for s in sorted(counts, reverse=True):
        if gap <= DP_WORDS:
            break
        k = min(counts[s] - take[s], (gap - DP_WORDS) // s)
        if k > 0:
            take[s] += k
            gap -= s * k
    # Sums reachable with the sizes so far, as the bits of one integer; a size with c documents
    # left is added in blocks of 1, 2, 4, ... documents.
    reach, steps, cut = 1, [], (1 << (gap + 1)) - 1
    for s in sorted(counts):
        if s > gap or reach >> gap & 1:
            break
        spare, block = min(counts[s] - take[s], gap // s), 1
        while spare:
            n = min(block, spare)
            new = (reach | reach << (s * n)) & cut
            if new != reach:
                steps.append((s, n, reach))
                reach = new
            spare -= n
            block *= 2
    at = reach.bit_length() - 1
    for s, n, before in reversed(steps):
        if not before >> at & 1:
            take[s] += n
            at -= s * n
    return take


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    target, whole = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
    passes = min(2, int(target // whole)) if whole else 0
    counts = {int(s): int(c) for s, c in zip(group["size"], group["n"]) if s > 0}
    budget = max(0, round(target - passes * whole)) if passes < 2 else 0
    take = fit(counts, budget) if budget else {}
    out = group[["source", "size", "n"]].copy()
    out["passes"] = passes
    out["extra"] = [take.get(int(s), 0) for s in group["size"]]
    return out


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, size, source_size, target, times, taken): how often each document is taken.

    ``times`` is 0, 1 or 2 and ``taken`` is ``times * size``. A null text has size 0; a document
    of size 0 is taken as often as its source is taken whole. A null source is a source, the last.
    Rows with one id are told apart by their text and what is kept, so runs agree whatever the layout.
    """
    ship(docs.sparkSession)
    extra = [c for c in dict.fromkeys(keep) if c != id_col]
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        word_count(F.col(text_col)).alias("_size"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BUCKETS)).cast("int").alias("_b"),
        F.xxhash64(F.lit(seed + 2), F.col(text_col)).alias("_t"),
        *[column(c).alias(f"_k{i}") for i, c in enumerate(extra)],
    )
    # One count per source, size and hash bucket; all that follows works on counts.
    fine = checkpoint(base.groupBy("_source", "_size", "_b").agg(F.count(F.lit(1)).alias("n")))
    sizes = fine.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.sum("n").alias("n"))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, share)
    kind = docs.schema[source_col].dataType.simpleString()
    plan = checkpoint(
        sizes.join(F.broadcast(targets), sizes["source"].eqNullSafe(targets["source"]))
        .select(sizes["source"], "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(_plan, f"source {kind}, size long, n long, passes long, extra long")
    )
    # Buckets of a size are taken in order until ``extra`` documents are reached: one row for each
    # size says where that happens. The last bucket may be taken in part; only its rows are ranked.
    order = Window.partitionBy("_source", "_size").orderBy("_b")
    upto = fine.withColumn("before", F.sum("n").over(order) - F.col("n"))
    p = plan.filter("extra > 0").select(F.col("source").alias("_ps"), F.col("size").alias("_pz"), "extra")
    cuts = checkpoint(
        upto.join(p, upto["_source"].eqNullSafe(p["_ps"]) & (upto["_size"] == p["_pz"]))
        .filter("before < extra and extra <= before + n")
        .select(F.col("_source").alias("_cs"), F.col("_size").alias("_cz"), F.col("_b").alias("_cut"), (F.col("extra") - F.col("before")).alias("_take"), F.col("n").alias("_have"))
    )
    # One row per source and size: counted and sent to the documents, which keep their texts where they are.
    cuts = broadcast_if_small(cuts)
    held = base.join(cuts, base["_source"].eqNullSafe(cuts["_cs"]) & (base["_size"] == cuts["_cz"]), "left").drop("_cs", "_cz")
    split = F.coalesce((F.col("_b") == F.col("_cut")) & (F.col("_take") < F.col("_have")), F.lit(False))
    sure = held.filter(~split).withColumn("_in", F.coalesce(F.col("_b") <= F.col("_cut"), F.lit(False)))
    # Rows that agree in id, text and all that is kept are the same to any reader.
    rest = [F.to_json(F.struct(*[F.col(f"_k{i}") for i in range(len(extra))]))] if extra else []
    rank = F.row_number().over(Window.partitionBy("_source", "_size").orderBy(F.xxhash64(F.lit(seed + 1), F.col("_id")), "_id", "_t", *rest))
    ranked = held.filter(split).withColumn("_r", rank).withColumn("_in", F.col("_r") <= F.col("_take")).drop("_r")
    passes = plan.groupBy("source").agg(F.max("passes").alias("passes"))
    per_source = targets.join(passes, targets["source"].eqNullSafe(passes["source"])).select(targets["source"].alias("_ts"), "source_size", "target", "passes")
    done = sure.unionByName(ranked)
    return done.join(F.broadcast(per_source), done["_source"].eqNullSafe(per_source["_ts"])).select(
        F.col("_id").alias(id_col),
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(extra)],
        F.col("_size").alias("size"), "source_size", "target",
        (F.col("passes") + F.col("_in").cast("long")).alias("times"),
        ((F.col("passes") + F.col("_in").cast("long")) * F.col("_size")).alias("taken"),
    )
