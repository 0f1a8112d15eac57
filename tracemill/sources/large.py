"""Record lists of JSON documents of any size, read by many tasks.

A document is read as text that ends at each closing brace, which Spark cuts into splits by bytes. Where
a split begins is known only from all before it: whether inside a string, and how deep. So the document
is read three times and never moved:

1. each split reports its quotes, how much deeper it ends, and where, at each depth, a list of objects
   begins, for both cases of its first byte; running sums over the splits then give every split's start;
2. each split counts the separators of the record list in it, and running sums number its records;
3. each split cuts its records; only pieces of records that cross the border of a split are joined.

Rows are those of ``extract_records`` over whole documents, if the documents are valid JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.session import checkpoint

_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = 34, 92, 44, 91, 93
_STEP = np.zeros(256, np.int8)
_STEP[[91, 123]] = 1
_STEP[[93, 125]] = -1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True

SUMMARY = "path string, start long, quotes long, first string, first_at long, deeper array<long>, lists array<array<struct<depth:long,at:long>>>"
PIECE = "path string, start long, record_no long, text string, whole boolean"


class Scan:
    """Structure of a stretch of bytes that begins inside a string or not."""

    def __init__(self, data: np.ndarray, in_string: bool):
        quote = data == _QUOTE
        slash = data == _BACKSLASH
        if slash.any():
            place = np.arange(len(data))
            plain = np.maximum.accumulate(np.where(slash, -1, place))  # last byte that is no backslash
            escaped = np.zeros(len(data), bool)
            escaped[1:] = ((place - plain) % 2 == 1)[:-1]
            quote &= ~escaped
        before = np.cumsum(quote) - quote + in_string
        self.quotes = int(quote.sum())
        self.plain = (before % 2 == 0) & ~quote
        self.step = np.where(self.plain, _STEP[data], 0).astype(np.int64)
        self.depth = np.cumsum(self.step)  # after each byte, from the stretch's begin
        self.data = data

    def lists(self) -> Iterator[tuple[int, int]]:
        """(depth inside, place) of the brackets that open a list of objects."""
        at = np.flatnonzero(self.plain & ((self.data == _OPEN) | (self.data == 123)))
        if len(at) < 2:
            return
        pair = np.flatnonzero((self.data[at[:-1]] == _OPEN) & (self.data[at[1:]] == 123))
        filled = np.cumsum(~_BLANK[self.data])
        for i in pair.tolist():
            if filled[at[i + 1]] - filled[at[i]] == 1:
                yield int(self.depth[at[i]]), int(at[i])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, dict]]:
    """((path, start), bytes, other columns) of the rows of a split, a batch at a time."""
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()))
        lo = 0
        while lo < len(keys):
            hi = lo
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            text = "}".join(batch.column("value").slice(lo, hi - lo).to_pylist()) + "}"
            extra = {c: batch.column(c)[lo].as_py() for c in batch.schema.names if c not in ("path", "start", "value")}
            yield keys[lo], np.frombuffer(text.encode(), np.uint8), extra
            lo = hi


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split, for a begin outside and inside a string."""
    seen: dict[tuple, list] = {}
    for key, data, _ in _stretches(batches):
        s = seen.setdefault(key, [0, None, [0, 0], [{}, {}], 0, None])
        if s[1] is None:
            filled = np.flatnonzero(~_BLANK[data])
            if len(filled):
                s[1], s[5] = chr(data[filled[0]]), s[4] + int(filled[0])
        for case in (0, 1):
            scan = Scan(data, (s[0] + case) % 2 == 1)
            for depth, at in scan.lists():
                s[3][case].setdefault(s[2][case] + depth, s[4] + at)
            s[2][case] += int(scan.depth[-1])
        s[0] += scan.quotes
        s[4] += len(data)
    rows = [(*k, s[0], s[1], s[5], s[2], [[{"depth": d, "at": a} for d, a in x.items()] for x in s[3]]) for k, s in seen.items()]
    if rows:
        fields = [pa.list_(pa.int64()), pa.list_(pa.list_(pa.struct([("depth", pa.int64()), ("at", pa.int64())])))]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*("path", "start", "quotes", "first", "first_at", "deeper", "lists")])


class _Reader:
    """Separators of the record list as the stretches of one split go by."""

    def __init__(self, told: dict):
        self.in_string, self.depth, self.offset = told["in_string"], told["depth"], 0
        self.opens, self.level = told["opens"], told["level"]
        self.active = told["active"]

    def cuts(self, data: np.ndarray) -> tuple[list[int], int, bool]:
        """(places of separators in ``data``, where the list's content begins or -1, whether it ends at the last place)."""
        scan = Scan(data, self.in_string)
        depth = scan.depth + self.depth
        begin, ended = -1, False
        if not self.active and 0 <= self.opens - self.offset < len(data):
            begin, self.active = self.opens - self.offset + 1, True
        places: list[int] = []
        if self.active:
            lo = max(begin, 0)
            close = np.flatnonzero(scan.plain[lo:] & (depth[lo:] == self.level - 1) & (scan.step[lo:] < 0))
            hi = lo + int(close[0]) if len(close) else len(data)
            at = np.flatnonzero(scan.plain[lo:hi] & (data[lo:hi] == _COMMA) & (depth[lo:hi] == self.level)) + lo
            places, ended = at.tolist(), bool(len(close))
            if ended:
                places.append(hi)
        self.in_string = (self.in_string + scan.quotes) % 2 == 1
        self.depth, self.offset = int(depth[-1]), self.offset + len(data)
        return places, begin, ended


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, list] = {}
    for key, data, told in _stretches(batches):
        state = seen.setdefault(key, [_Reader(told), 0, False])
        if state[2]:
            continue
        places, _, ended = state[0].cuts(data)
        state[1] += len(places) - ended
        state[2] = ended
    if seen:
        rows = [(*k, s[1], s[2]) for k, s in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "start", "separators", "ended"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a split; the piece before its first separator and the one after its last are not whole."""
    now: tuple | None = None
    reader, number, held, whole, done = None, 0, [], False, False
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "start", "record_no", "text", "whole"])
        rows.clear()
        return out

    for key, data, told in _stretches(batches):
        if key != now:
            if held:
                rows.append((*now, number, b"".join(held).decode(), False))
            now, reader, number, held, whole, done = key, _Reader(told), told["records"], [], False, False
        if done:
            continue
        was = reader.active
        places, begin, ended = reader.cuts(data)
        if not reader.active:
            continue
        raw, lo = data.tobytes(), max(begin, 0)
        if not was:
            whole = True  # the first record begins here
        for at in places:
            held.append(raw[lo:at])
            rows.append((*key, number, b"".join(held).decode(), whole))
            held, whole, lo, number = [], True, at + 1, number + 1
        done = ended
        if not ended:
            held.append(raw[lo:])
        if rows:
            yield batch()
    if held:
        rows.append((*now, number, b"".join(held).decode(), False))
    if rows:
        yield batch()


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_no, record) of the record list of each JSON document under ``path``.

    The list is found as in ``record_list``: a root list, or the first member of a root object that is
    a list of objects; documents without one give no rows. A split has the size that
    ``spark.sql.files.maxPartitionBytes`` sets; one record may be longer. What is sent to all tasks is
    a few numbers per split.
    """
    parts = _fragments(spark, path)
    begun = checkpoint(parts.mapInArrow(_summaries, SUMMARY))
    whole = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    case = F.when(F.col("in_string"), 1).otherwise(0)
    begun = begun.withColumn("_deeper", F.get("deeper", case)).withColumn("depth", F.coalesce(F.sum("_deeper").over(before), F.lit(0)))
    begun = begun.withColumn("_root", F.first("first", ignorenulls=True).over(whole))
    member = F.get(F.filter(F.get("lists", case), lambda x: x["depth"] + F.col("depth") == 2), F.lit(0))["at"]
    at = F.when(F.col("_root") == "[", F.col("first_at")).when(F.col("_root") == "{", member)
    begun = begun.withColumn("_open", F.min(F.when(at.isNotNull(), F.struct("start", at.alias("at")))).over(whole))
    told = checkpoint(begun.filter(F.col("_open.start") <= F.col("start")).select(
        "path", "start", "in_string", "depth", F.when(F.col("_root") == "[", 1).otherwise(2).alias("level"),
        F.when(F.col("_open.start") == F.col("start"), F.col("_open.at")).otherwise(-1).alias("opens"),
        (F.col("_open.start") < F.col("start")).alias("active"),
    ))
    counted = parts.join(F.broadcast(told), ["path", "start"]).mapInArrow(_count, "path string, start long, separators long, ended boolean")
    placed = told.join(counted, ["path", "start"]).withColumn("records", F.coalesce(F.sum("separators").over(before), F.lit(0)))
    placed = placed.withColumn("_past", F.coalesce(F.max("ended").over(before), F.lit(False)))
    placed = checkpoint(placed.filter(~F.col("_past")).select(*told.columns, "records"))
    pieces = checkpoint(parts.join(F.broadcast(placed), ["path", "start"]).mapInArrow(_cut, PIECE))
    joined = pieces.filter(~F.col("whole")).groupBy("path", "record_no").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("_p"))
    joined = joined.select("path", "record_no", F.array_join("_p.text", "").alias("text"))
    texts = pieces.filter("whole").select("path", "record_no", "text").unionByName(joined).filter(F.col("text").rlike(r"\S"))
    level = placed.groupBy("path").agg(F.max("level").alias("level"))
    one = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    # A member's records go through a variant, as ``record_list`` has them.
    listed = F.when(F.col("level") == 2, F.to_json(F.try_parse_json(one))).otherwise(one)
    return texts.join(F.broadcast(level), "path").select("path", "record_no", F.get(F.from_json(listed, "array<string>"), F.lit(0)).alias("record"))
