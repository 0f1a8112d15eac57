"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a long run of characters that keys and tokens are written in. Its class (hex digits,
letters and digits, or the wider Base64 set) gives the width of the sliding window and the entropy
that marks it. The sum of n log n over the window's character counts is carried from window to
window, so a candidate of any length takes one step per character. Allow-listed strings are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import column, ship
from tracemill.llm import text as X

# Fixed patterns of the kinds, in their order; over UTF-8 bytes, where they match ASCII only.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "entropy")
HEX = b"0123456789abcdef"
CANDIDATE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


class EntropyClass(NamedTuple):
    """Characters of a class, the window's width, and the entropy in bits that marks a window."""

    name: str
    pattern: re.Pattern
    window: int
    bits: float


# The narrowest class that holds the whole candidate decides.
CLASSES = (
    EntropyClass("hex", re.compile(rb"[0-9a-fA-F]+"), 24, 3.0),
    EntropyClass("alphanumeric", re.compile(rb"[A-Za-z0-9]+"), 20, 3.65),
    EntropyClass("base64", re.compile(rb"[A-Za-z0-9+/_=-]+"), 24, 3.9),
)
LEAST = min(c.window for c in CLASSES)
# What is known to be no secret: placeholders, identifiers with a fixed form, plain words. Each part of a
# pattern reads a string in one way only, so a long one that fails at its end takes linear time.
ALLOW = (
    rb"(?i).*(example|placeholder|changeme|redacted|sample|dummy|x{6,}).*",
    rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    rb"[A-Z]?[a-z]++([_=/+-]++[A-Z]?[a-z]++)*+[_=/+-]*+",
    rb"[A-Z]+([_=/+-]+[A-Z]+)*[_=/+-]*",
    rb"[0-9_=/+-]+",
)


def long_runs(data: np.ndarray, offsets: np.ndarray, chars: bytes, least: int) -> np.ndarray:
    """(start, end) of maximal runs of ``chars`` of at least ``least`` bytes within a row."""
    member = np.zeros(256, dtype=bool)
    member[list(chars)] = True
    base = int(offsets[0])
    inside = member[data[base : int(offsets[-1])]]
    if len(inside) < least:
        return np.zeros((0, 2), np.int64)
    new = np.zeros(len(inside) + 1, dtype=bool)
    new[offsets - base] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | new[1:-1]
    last[:-1] &= ~inside[1:] | new[1:-1]
    spans = np.stack([np.flatnonzero(begin), np.flatnonzero(last) + 1], axis=1)
    return spans[spans[:, 1] - spans[:, 0] >= least] + base


def entropy_span(s: bytes, window: int, bits: float) -> tuple[int, int] | None:
    """First and last position covered by windows of at least ``bits``; None without one."""
    if len(s) < window:
        return None
    weigh = [0.0] + [n * log2(n) for n in range(1, window + 1)]
    counts = [0] * 256
    total = 0.0
    limit = (log2(window) - bits) * window + 1e-9  # of the sum of n log n
    first = last = None
    for i, c in enumerate(s):
        n = counts[c]
        total += weigh[n + 1] - weigh[n]
        counts[c] = n + 1
        if i >= window:
            old = s[i - window]
            n = counts[old]
            total += weigh[n - 1] - weigh[n]
            counts[old] = n - 1
        if i >= window - 1 and total <= limit:
            first = i - window + 1 if first is None else first
            last = i + 1
    return None if first is None else (first, last)


def _scan(data: np.ndarray, offsets: np.ndarray, allow: list[re.Pattern]) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> (start, kind number, end) in bytes from the row's first."""
    base, end = int(offsets[0]), int(offsets[-1])
    body = data[base:end]
    found: dict[int, list[tuple[int, int, int]]] = {}

    def owner(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, at, side="right") - 1

    marks = np.flatnonzero((body == 0x3A) | (body == 0x3D)) + base
    for row in np.unique(owner(marks)).tolist() if len(marks) else []:
        text = data[offsets[row] : offsets[row + 1]].tobytes()
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.setdefault(row, []).append((m.start(), 0, m.end()))
    whole = body.tobytes()
    at = whole.find(b"AKIA")
    rows: set[int] = set()
    while at >= 0:
        rows.add(int(owner(np.array([at + base]))[0]))
        at = whole.find(b"AKIA", at + 4)
    for row in sorted(rows):
        for m in ACCESS.finditer(whole[int(offsets[row]) - base : int(offsets[row + 1]) - base]):
            if m.end() - m.start() >= 20:
                found.setdefault(row, []).append((m.start(), 1, m.end()))
    spans = long_runs(data, offsets, HEX, 24)
    for row, (s, e) in zip(owner(spans[:, 0]).tolist(), spans.tolist()):
        found.setdefault(row, []).append((s - int(offsets[row]), 2, e - int(offsets[row])))
    fixed: dict[int, tuple[list[int], list[int]]] = {}  # starts, and the furthest end up to each
    spans = long_runs(data, offsets, CANDIDATE, LEAST)
    for row, (s, e) in zip(owner(spans[:, 0]).tolist(), spans.tolist()):
        text = data[s:e].tobytes()
        if any(p.fullmatch(text) for p in allow):
            continue
        cls = next(c for c in CLASSES if c.pattern.fullmatch(text))
        hit = entropy_span(text, cls.window, cls.bits)
        if hit:
            off = s - int(offsets[row])
            a, b = off + hit[0], off + hit[1]
            if row not in fixed:
                known = sorted(found.get(row, ()))
                fixed[row] = [x for x, _, _ in known], list(accumulate((y for _, _, y in known), max))
            starts, ends = fixed[row]
            at = bisect_right(starts, a) - 1
            if at < 0 or ends[at] < b:
                found.setdefault(row, []).append((a, 3, b))
    return found


def _spans(batch: pa.RecordBatch, text_at: int, allowed: list[re.Pattern]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict]]:
    """(first row, row after, bytes, offsets, row -> sorted (start, kind number, end) in bytes) of parts of a batch."""
    data, offsets = X.utf8(batch.column(text_at))
    for lo, hi in X.groups(offsets):
        at = offsets[lo : hi + 1]
        yield lo, hi, data, at, {row: sorted(hits) for row, hits in _scan(data, at, allowed).items()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[bytes, ...] = ALLOW, keep: tuple[str, ...] = (), spans_col: str = "spans") -> DataFrame:
    """(id, *keep, spans): ``spans`` are (kind, start, end) in code points, by start, then kind.

    Kinds are those of ``KINDS``; entropy spans within a span of another kind are not repeated. A
    null or empty text has no spans. Repeated rows give repeated rows.
    """
    ship(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    out = [c for c in columns if c == id_col or c in keep]
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in out] + [T.StructField(spans_col, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = [re.compile(p) for p in allow]
        for batch in batches:
            for lo, hi, data, at, found in _spans(batch, 1, allowed):
                spans: list[list] = [[] for _ in range(hi - lo)]
                for row, hits in found.items():
                    text = data[at[row] : at[row + 1]]
                    chars = np.zeros(len(text) + 1, dtype=np.int64)
                    np.cumsum((text & 0xC0) != 0x80, out=chars[1:])
                    spans[row] = [{"kind": KINDS[k], "start": int(chars[s]), "end": int(chars[e])} for s, k, e in hits]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(columns.index(c)) for c in out), pa.array(spans, pa.list_(span))], [*out, spans_col])

    return docs.select(*[column(c).alias(f"_d{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


MASK = "[SECRET]"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by ``MASK``; overlapping spans by one.

    Texts without a span, null included, stay as they are, as do the other columns.
    """
    ship(docs.sparkSession)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = [re.compile(p) for p in ALLOW]
        for batch in batches:
            for lo, hi, data, at, found in _spans(batch, at_text, allowed):
                part = batch.slice(lo, hi - lo)
                if found:
                    texts = part.column(at_text)
                    kept = {row: _masked(data[at[row] : at[row + 1]].tobytes(), hits) for row, hits in found.items()}
                    new = pa.array([kept.get(i) for i in range(hi - lo)], texts.type)
                    part = part.set_column(at_text, part.schema.field(at_text), pc.coalesce(new, texts))
                yield part

    # Numbered names, as those of ``docs`` may hold dots.
    plain = docs.toDF(*[f"_d{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _masked(text: bytes, hits: list[tuple[int, int, int]]) -> str:
    """A text with ``MASK`` for its spans, which are sorted by start."""
    out, at = [], 0
    for s, _, e in hits:
        if s >= at or not out:
            out += [text[at:s], MASK.encode()]
        at = max(at, e)
    return b"".join([*out, text[at:]]).decode()
