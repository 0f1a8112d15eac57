"""Readers for process exports and the search for the record list inside a JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.columns import named
from tracemill.sources.large import read_records
from tracemill.sources.schema import collect_facts, paths, plain_names, record_type


class NoRecords(ValueError):
    """No document holds a list of records."""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, (path, document)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def read_upload(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """A CSV file with header, a JSON array, or (``lines``) splittable JSON lines.

    With ``split`` many tasks read one JSON array.
    """
    if split and not path.lower().endswith(".csv"):
        return records_table(read_records(spark, path).select("record"))
    if path.lower().endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", not lines)
        return reader.option("escape", '"').csv(path)
    return spark.read.option("multiLine", not lines).json(path)


def _is_record_list(value: Column) -> Column:
    first = F.try_variant_get(value, "$[0]", "variant")
    return F.coalesce(
        F.schema_of_variant(value).startswith("ARRAY<")
        & F.schema_of_variant(first).startswith("OBJECT<"),
        F.lit(False),
    )


def record_list(document: Column) -> Column:
    """The records as JSON texts; an empty array when there are none.

    A root list is taken as it is; in a root object, the first member in document order
    that is a non-empty list starting with an object.
    """
    root = F.from_json(document, "array<string>")
    members = F.map_values(F.from_json(document, "map<string,variant>"))
    found = F.get(F.filter(members, _is_record_list), F.lit(0))
    nested = F.from_json(F.to_json(found), "array<string>")
    return F.coalesce(root, nested, F.array().cast("array<string>"))


def extract_records(documents: DataFrame, document: str = "document") -> DataFrame:
    """One row per record: the other columns, ``record_no`` (from 0) and ``record``."""
    keep = [c for c in documents.columns if c != document]
    return documents.select(
        *keep, F.posexplode(record_list(F.col(document))).alias("record_no", "record")
    )


def documents_without_records(documents: DataFrame, document: str = "document") -> DataFrame:
    """Documents in which no record list is found."""
    return documents.filter(F.size(record_list(F.col(document))) == 0).drop(document)


def records_table(records: DataFrame, schema: str | T.StructType | None = None) -> DataFrame:
    """S3: records as typed columns next to the carried ones.

    Without ``schema`` the union of all record fields is found by one distributed
    aggregate (see ``schema``); only one row per field path reaches the driver.
    """
    told = infer_record_schema(records) if schema is None else schema
    record = F.from_json("record", told)
    if schema is None and plain_names(told) != told:
        record = record.cast(plain_names(told))
    return records.withColumn("_r", record).select(*[named(c) for c in records.columns if c != "record"], "_r.*")


def infer_record_schema(records: DataFrame) -> T.StructType:
    kind = record_type(collect_facts(paths(records)))
    if not isinstance(kind, T.StructType):
        raise NoRecords("no list of records found in the given documents")
    return kind


def load_table(spark: SparkSession, path: str, schema: str | None = None, split: bool = False) -> DataFrame:
    """S1 + S2 + S3: the record list of JSON files as a table, with ``path`` and ``record_no``.

    With ``split`` many tasks read one document (see ``large``), which must be valid JSON.
    """
    records = read_records(spark, path) if split else extract_records(read_documents(spark, path))
    return records_table(records, schema)
