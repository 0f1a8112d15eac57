"""JSON export of analysis results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_documents(diagnosis: DataFrame, workflow: DataFrame, recommendations: DataFrame, key: str) -> DataFrame:
    """(key, document) with members diagnosis, workflow and recommendations.

    Each input has one row per ``key``; a key absent from an input gets a null member.
    """
    parts = {"diagnosis": diagnosis, "workflow": workflow, "recommendations": recommendations}
    joined = None
    for name, df in parts.items():
        body = [c for c in df.columns if c != key]
        part = df.select(key, F.struct(*body).alias(name))
        joined = part if joined is None else joined.join(part, key, "full")
    text = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return joined.select(key, text.alias("document"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, written by the executors."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
