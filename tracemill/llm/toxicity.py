"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning reads a bounded sample of labelled rows (``MAX_ROWS``); scoring covers every whole text.
Each coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so
the model is a short list of (feature, weight) that every task holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import column, ship
from tracemill.llm import text as X

BITS = 21
# Bytes of texts whose features are held at once; a byte takes up to 60 bytes of arrays.
TEXT_BYTES = 1 << 20
MAX_ROWS = 8_000  # labelled rows learned from; those with the smallest hash of their id
SKIPS = (2, 3)  # distances of the words of a skip-gram
STEMS = (4, 5, 6)  # first bytes of a word that count as a word of their own


class Settings(NamedTuple):
    """FTRL-proximal: rate alpha / (beta + sqrt(sum of squared gradients)) per coordinate."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 5.0  # for a thousand rows; grows with the root of their number
    l2: float = 0.0
    epochs: int = 3


class Model(NamedTuple):
    features: np.ndarray  # int32, rising; feature 0 is the bias
    weights: np.ndarray  # float32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word, word start, pair of neighbours and skip-gram, with repeats."""
    words = X.runs(data, offsets, lower=True)
    key, doc = words.key, words.doc
    found = [(doc, key)]
    length = words.end - words.start
    for n in STEMS:
        at = np.flatnonzero(length >= n)
        stem = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            b = data[words.start[at] + j]
            b = np.where((b >= 65) & (b <= 90), b + 32, b)
            stem = stem * np.uint64(0x100000001B3) + b
        found.append((doc[at], X.mix(stem + np.uint64(0x5851F42D4C957F2D))))
    for gap in (1, *SKIPS):
        if len(key) > gap:
            at = np.flatnonzero(doc[gap:] == doc[:-gap])
            pair = key[at] * np.uint64(0xD6E8FEB86659FD93) + key[at + gap] + np.uint64(gap)
            found.append((doc[at], X.mix(pair)))
    row = np.concatenate([f[0] for f in found])
    feature = (np.concatenate([f[1] for f in found]) >> np.uint64(64 - BITS)).astype(np.int64)
    return row, np.maximum(feature, 1)


def learn(rows: list[tuple[np.ndarray, int]], settings: Settings = Settings()) -> Model:
    """FTRL-proximal over (distinct features, label) rows, in a seeded order."""
    s, size = settings._replace(l1=settings.l1 * (len(rows) / 1000) ** 0.5), 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            f, label = rows[i]
            zf, nf = z[f], n[f]
            root = np.sqrt(nf)
            w = np.where(np.abs(zf) <= s.l1, 0.0, (np.sign(zf) * s.l1 - zf) / ((s.beta + root) / s.alpha + s.l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = nf + g * g
            z[f] = zf + g - (np.sqrt(grown) - root) / s.alpha * w
            n[f] = grown
    w = np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    kept = np.flatnonzero(w)
    return Model(kept.astype(np.int32), w[kept].astype(np.float32))


def fit(labelled: DataFrame, label_col: str = "label", text_col: str = "text", settings: Settings = Settings()) -> Model:
    """Learn from (text, label) rows, of which there must be a bounded number.

    A null text counts as empty; rows with a null label are left out. Without rows the model scores
    0.5 for every text.
    """
    ship(labelled.sparkSession)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch.column(0))
            for lo, hi in X.groups(offsets, TEXT_BYTES):
                row, feature = features(data, offsets[lo : hi + 1])
                pairs = np.unique(row << BITS | feature)
                at = X.bounds(pairs >> BITS, hi - lo)
                feature = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                lists = [np.append(feature[at[i] : at[i + 1]], np.int32(0)).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), batch.column(1).slice(lo, hi - lo)], ["f", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [(f, y) for batch in batches for f, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        lists.sort(key=lambda r: (zlib.crc32(r[0]), r))  # the same order however the rows arrive
        model = learn([(np.frombuffer(f, np.int32), y) for f, y in lists], settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.features.tobytes()]), pa.array([model.weights.tobytes()])], ["f", "w"])

    rows = labelled.filter(F.col(label_col).isNotNull()).select(text_col, F.col(label_col).cast("int"))
    one = rows.mapInArrow(prepare, "f binary, label int").repartition(1)
    got = [r for r in one.mapInArrow(run, "f binary, w binary").collect() if r.f is not None]
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32))
    return Model(np.frombuffer(got[0].f, np.int32), np.frombuffer(got[0].w, np.float32))


def sample(docs: DataFrame, labels: DataFrame, eligible, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` (text, label) of labelled documents; one row per id.

    ``eligible`` is a condition on the id. An id labelled twice takes the larger label, one with
    several texts the smallest.
    """
    ids = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & eligible)
        .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(3), F.col(id_col)), id_col).limit(max_rows)
    )
    # Bounded by max_rows, as the limit above shows.
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min(text_col).alias("text"), F.max("label").alias("label")).select("text", "label")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, id, score): chance that the label is 1, from the text alone.

    A feature counts once per text. A null or empty text scores the bias. Repeated rows give
    repeated rows.
    """
    ship(docs.sparkSession)
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    out = [c for c in columns if c == id_col or c in keep]
    schema = T.StructType([docs.schema[c] for c in out] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS, dtype=np.float64)
        weight[model.features] = model.weights
        used = weight != 0
        for batch in batches:
            data, offsets = X.utf8(batch.column(1))
            for lo, hi in X.groups(offsets, TEXT_BYTES):
                row, feature = features(data, offsets[lo : hi + 1])
                hit = used[feature]
                pairs = np.unique(row[hit] << BITS | feature[hit])
                total = weight[0] + np.bincount(pairs >> BITS, weights=weight[pairs & ((1 << BITS) - 1)], minlength=hi - lo)
                part = batch.slice(lo, hi - lo)
                chance = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(part.column(columns.index(c)) for c in out), pa.array(chance)], [*out, "score"])

    return docs.select(*[column(c).alias(f"_d{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def frame(model: Model) -> pd.DataFrame:
    """The model as (feature, weight) rows, for reports and storage."""
    return pd.DataFrame({"feature": model.features, "weight": model.weights})
