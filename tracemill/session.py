"""Session helpers: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is at most this many rows; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000
# Rows that a task of a shuffle takes, about, where their number is known before.
TASK_ROWS = 250_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch one only for local-mode runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tracemill-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with a short lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as a table and read again, for loops whose rounds join.

    A checkpoint keeps the size estimated for its plan. A join multiplies those of its sides, so the
    estimate's digits double with each round until planning takes minutes; a table has the size of its files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; ``df`` should be checkpointed or tiny to count.

    Above the limit the join shuffles and adaptive execution splits skewed keys.
    """
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that a join shuffles, whatever size is estimated for it.

    Estimates come from compressed files and do not see rows that ``explode`` adds, so a side
    of many rows may pass for a small one and would be collected on the driver.
    """
    return df.hint("merge")


def shuffle_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` rows: as configured, and more once tasks would take more than ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))
