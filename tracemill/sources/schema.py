"""The type of JSON records, found as facts about field paths that merge in any order (S3).

Each path (field names, and 0 for the elements of a list) has a set of kinds as bits and the most digits
of its whole numbers. Kinds merge by bitwise or, digits by maximum, so partial results of any part of
the data add up; only the distinct paths reach the driver. From the facts of a path follows its type:

    null alone -> string          boolean -> boolean        objects -> struct of their fields
    whole numbers of 64 bits -> bigint, up to 38 digits -> decimal, beyond -> string
    whole and other numbers -> double     lists -> array of what their elements are
    anything mixed -> string, which keeps the JSON text

Fields that differ only in case get a number behind the later names, as columns do not tell case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BOOLEAN, LONG, WHOLE, DOUBLE, STRING, LIST, OBJECT = (1 << i for i in range(8))
NUMBERS = LONG | WHOLE | DOUBLE
MOST_DIGITS = 38

Facts = dict[tuple, tuple[int, int]]


def _fact(kind: int, digits: int = 0) -> tuple[int, int]:
    return kind, digits


def _whole(text: str) -> tuple[int, int]:
    digits = len(text.lstrip("-").lstrip("0")) or 1
    return _fact(LONG if digits < 19 or -(2**63) <= int(text) < 2**63 else WHOLE, digits)


def _double(text: str) -> tuple[int, int]:
    return _fact(DOUBLE)


def gather(record: str | None, facts: Facts) -> None:
    """Add the facts of one record; text that is no JSON adds nothing."""
    if record is None:
        return
    try:
        root = json.loads(record, parse_int=_whole, parse_float=_double, parse_constant=_double)
    except (ValueError, RecursionError):
        return
    stack: list[tuple[tuple, object]] = [((), root)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, tuple):
            kind, digits = value
        else:
            digits = 0
            if isinstance(value, dict):
                kind = OBJECT
                stack.extend(((*path, name), v) for name, v in value.items())
            elif isinstance(value, list):
                kind = LIST
                stack.extend(((*path, 0), v) for v in value)
            else:
                kind = NULL if value is None else BOOLEAN if isinstance(value, bool) else STRING
        old = facts.get(path, (0, 0))
        facts[path] = old[0] | kind, max(old[1], digits)


def paths(records: DataFrame, column: str = "record") -> DataFrame:
    """(path, kinds, digits): the facts of all records, ``path`` as JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts: Facts = {}
        for batch in batches:
            for record in batch.column(0).to_pylist():
                gather(record, facts)
        if facts:
            names = [json.dumps(p) for p in facts]
            kinds, digits = zip(*facts.values())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds, pa.int32()), pa.array(digits, pa.int32())], ["path", "kinds", "digits"])

    found = records.select(F.col(column)).mapInArrow(run, "path string, kinds int, digits int")
    return found.groupBy("path").agg(F.bit_or("kinds").alias("kinds"), F.max("digits").alias("digits"))


def _children(facts: Facts) -> dict[tuple, list]:
    out: dict[tuple, list] = {}
    for path in facts:
        if path:
            out.setdefault(path[:-1], []).append(path[-1])
    return out


def record_type(facts: Facts) -> T.DataType:
    """The type of the objects at the root, exact field names sorted by code point."""
    below = _children(facts)

    def of(path: tuple) -> T.DataType:
        kinds, digits = facts.get(path, (0, 0))
        kinds &= ~NULL
        if not path and kinds & OBJECT:  # records that are no objects are null rows
            kinds = OBJECT
        if kinds == OBJECT:
            fields = [T.StructField(n, of((*path, n))) for n in sorted(n for n in below.get(path, []) if n != 0)]
            return T.StructType(fields) if fields else T.StringType()
        if kinds == LIST:
            return T.ArrayType(of((*path, 0)))
        if kinds == BOOLEAN:
            return T.BooleanType()
        if kinds and not kinds & ~NUMBERS:
            if kinds == LONG:
                return T.LongType()
            if kinds & DOUBLE:
                return T.DoubleType()
            return T.DecimalType(digits, 0) if digits <= MOST_DIGITS else T.StringType()
        return T.StringType()

    return of(())


def plain_names(kind: T.DataType) -> T.DataType:
    """``kind`` with a number behind field names that differ from an earlier one only in case."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(plain_names(kind.elementType))
    if not isinstance(kind, T.StructType):
        return kind
    taken: set[str] = {f.name.lower() for f in kind}
    seen: set[str] = set()
    fields = []
    for f in kind:
        name, n = f.name, 2
        if name.lower() in seen:
            while f"{name}_{n}".lower() in taken:
                n += 1
            name = f"{name}_{n}"
            taken.add(name.lower())
        seen.add(name.lower())
        fields.append(T.StructField(name, plain_names(f.dataType)))
    return T.StructType(fields)


def collect_facts(found: DataFrame) -> Facts:
    """One row per distinct field path comes to the driver."""
    return {tuple(json.loads(r.path)): (r.kinds, r.digits) for r in found.collect()}
