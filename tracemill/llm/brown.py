"""Scores by a Brown class-based bigram model.

Every word belongs to one class, and a text's probability is the product, over its words and one end
per text, of a class transition and the emission of the word by its class. Classes come from exchange
clustering: a word moves to the class that raises the class-bigram likelihood of the training words
most. Clustering is distributed: the tasks of a round each exchange their own words in turn, from the
class counts of the last round; as the classes settle, fewer tasks take larger shares, so that
moves do not work against each other. Words above a rate of the training words are exchanged; the
number of such words is at most one over the rate, whatever the corpus. Every other word then takes
the class that explains its own neighbours best.

Texts are encoded once into segments: word numbers of a local list of word keys. Whatever the model
must know of a word is joined to these lists, not to the words of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import ship, stored
from tracemill.llm import text as X
from tracemill.session import broadcast_if_small, checkpoint

SEGMENT = 8 << 20  # bytes of text
RATE = 1e-4  # words at least as frequent are exchanged; at most 1 / RATE words
CLASSES = 32
TASKS = 16  # tasks of a round of the exchange
ROUNDS = (2, 2, 2, 3, 3, 3, 4, 4, 4, 4)  # one of so many hashed parts of the words moves in a round
DELTA = 0.1  # added to counts of words
PRIOR = 20.0  # strength of the class distribution behind a transition

MOST_CLASSES = 250  # a class number, with those of end and other words, is a byte of a fact
PLACE_BITS = 24  # of a place in a segment's list of keys, below the segment's number
# A segment is a few large values, so small row groups and no value dictionaries.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}

# Class numbers: 0 .. CLASSES - 1 by clustering, then the end of a text. A word of no known class
# (not in the training texts) leaves the class before it in force.
SEGMENTS = "segment long, keys binary, trained binary, doc binary, held binary, length binary, words binary"
NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def _planes(words: np.ndarray) -> bytes:
    """Numbers under 2**24 as three planes of bytes; the high ones, mostly 0, compress well."""
    return words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _unplane(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(3, -1)
    out = np.zeros((planes.shape[1], 4), dtype=np.uint8)
    out[:, :3] = planes.T
    return out.view("<u4").ravel().astype(np.int32)


class Segment(NamedTuple):
    """Texts of a segment. ``words`` are places in ``keys``, common ones first; ``length`` counts them per text."""

    keys: np.ndarray
    trained: np.ndarray  # how often each key stands in training texts
    held: np.ndarray
    length: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Segment:
        return cls(
            np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["trained"], np.int64), np.frombuffer(r["held"], bool),
            np.frombuffer(r["length"], np.int64), _unplane(r["words"]),
        )

    def stream(self, number: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, previous, this): every token, ends included, after the one before it.

        ``number`` gives each key's value; the token before a text's first is an end.
        """
        n = len(self.length)
        total = len(self.words) + n
        stop = np.cumsum(self.length + 1) - 1
        this = np.full(total, end, dtype=np.int64)
        inside = np.ones(total, dtype=bool)
        inside[stop] = False
        this[inside] = number[self.words]
        before = np.concatenate([[end], this[:-1]])
        return np.repeat(np.arange(n), self.length + 1), before, this


def _row(batch: pa.RecordBatch, i: int) -> dict:
    return {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _row(batch, i)


def encode(docs: DataFrame, id_col: str, text_col: str, held, segment: int = SEGMENT) -> DataFrame:
    """Segments of the texts; ids are kept as an Arrow array in ``doc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held_: list[np.ndarray] = []
        ids: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, size
            length, out = np.concatenate(lengths), np.concatenate(held_)
            distinct, words, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            if len(distinct) > 1 << PLACE_BITS:
                raise ValueError(f"a text has more than {1 << PLACE_BITS} distinct words")
            common = np.argsort(-times, kind="stable")
            place = np.empty(len(common), dtype=np.int32)
            place[common] = np.arange(len(common), dtype=np.int32)
            distinct, words = distinct[common], place[words]
            train = np.repeat(~out, length)
            trained = np.bincount(words[train], minlength=len(distinct)).astype(np.int64)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids[0].type)])) as w:
                for a in ids:
                    w.write_batch(pa.RecordBatch.from_arrays([a], ["id"]))
            row = [(task << 19) + serial, distinct.tobytes(), trained.tobytes(), sink.getvalue().to_pybytes(), out.tobytes(), length.astype(np.int64).tobytes(), _planes(words)]
            serial, size = serial + 1, 0
            for x in (keys, lengths, held_, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(row)], NAMES)

        for batch in batches:
            data, offsets = X.utf8(batch.column(1))
            out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in X.groups(offsets):
                r = X.runs(data, offsets[lo : hi + 1], lower=True)
                keys.append(r.key)
                lengths.append(np.bincount(r.doc, minlength=hi - lo))
                held_.append(out[lo:hi])
                ids.append(batch.column(0).slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                if size >= segment:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(id_col, text_col, held.alias("_held")).mapInArrow(run, SEGMENTS)


def frequent(segments: DataFrame, rate: float) -> np.ndarray:
    """Keys of words that make up at least ``rate`` of the training words; at most 1 / rate of them.

    Such a word reaches the rate in some segment. Those that do are candidates, and they alone are
    counted by key, over all segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            keys, n = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["trained"], np.int64)
            some = np.flatnonzero(n >= max(1, rate * n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(np.full(len(some), 0))], ["key", "total"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(n.sum())])], ["key", "total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            n = np.frombuffer(r["trained"], np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["keys"], np.int64)[some]), pa.array(n[some])], ["key", "n"])

    trained = segments.select("keys", "trained")
    light = checkpoint(trained.mapInArrow(run, "key long, total long"))
    total = light.agg(F.sum("total")).first()[0] or 0
    candidates = broadcast_if_small(light.filter("key is not null").select("key").distinct())
    counted = trained.mapInArrow(count, "key long, n long").join(candidates, "key", "left_semi")
    rows = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= rate * total).orderBy(F.desc("n"), "key").collect()
    return np.array([r.key for r in rows], dtype=np.int64).view(np.uint64)


def _numbers(keys: np.ndarray, known: np.ndarray, other: int) -> np.ndarray:
    """Position of each key in ``known`` or ``other``."""
    if not len(known):
        return np.full(len(keys), other, dtype=np.int64)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], keys), len(known) - 1)
    return np.where(known[order][at] == keys, order[at], other)


def adjacency(segments: DataFrame, words: np.ndarray) -> DataFrame:
    """(w, others, after, before): neighbours and their counts of each frequent word, in training texts.

    Numbers: a word's place in ``words``, then "another word", then "end". A row has at most as
    many entries as there are frequent words.
    """
    size = len(words) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            s = Segment.of(r)
            text, a, b = s.stream(_numbers(s.keys, words, size - 2), size - 1)
            train = ~s.held[text]
            pair, n = np.unique(a[train] * size + b[train], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair // size), pa.array(pair % size), pa.array(n)], ["a", "b", "n"])

    pairs = segments.drop("doc").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    after = pairs.select(F.col("a").alias("w"), F.struct(F.col("b").alias("o"), "n", F.lit(0).cast("long").alias("m")).alias("x"))
    before = pairs.select(F.col("b").alias("w"), F.struct(F.col("a").alias("o"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m")).alias("x"))
    grouped = (
        after.unionByName(before).groupBy("w", F.col("x.o").alias("o")).agg(F.sum("x.n").alias("n"), F.sum("x.m").alias("m"))
        .groupBy("w").agg(F.array_sort(F.collect_list(F.struct("o", "n", "m"))).alias("x"))
    )
    return checkpoint(grouped.select("w", F.col("x.o").alias("others"), F.col("x.n").alias("after"), F.col("x.m").alias("before")))


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_move(out: np.ndarray, into: np.ndarray, loops: float, own: int, g: np.ndarray, free: int) -> int:
    """The class that gives the largest class-bigram likelihood when a word moves there.

    ``out`` and ``into`` count the word's followers and predecessors by class, ``loops`` its
    repetitions; ``g`` are the class bigrams with the word in ``own``; classes from ``free`` on take
    no words.
    """
    g = g.copy()
    g[own] -= out
    g[:, own] -= into
    g[own, own] += loops
    out, into = out.copy(), into.copy()
    out[own] -= loops  # the word itself is in no class now
    into[own] -= loops
    row, col = g.sum(1) + into, g.sum(0) + out  # what its neighbours' classes get back wherever it goes
    gain = (_entropy(g + out) - _entropy(g)).sum(1) + (_entropy(g + into[:, None]) - _entropy(g)).sum(0)
    d = np.diag(g)  # the diagonal cell gets both shares and the loops
    gain += _entropy(d + out + into + loops) - _entropy(d + out) - _entropy(d + into) + _entropy(d)
    gain -= _entropy(row + out.sum() + loops) - _entropy(row) + _entropy(col + into.sum() + loops) - _entropy(col)
    best = int(np.argmax(gain[:free]))
    return best if gain[best] > gain[own] + 1e-9 else own


class _Links(NamedTuple):
    """Neighbours of some words: entry j of a word from start[i] to start[i + 1]."""

    word: np.ndarray
    start: np.ndarray
    other: np.ndarray
    after: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> _Links | None:
        t = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return None
        lists = [t[c].combine_chunks() for c in ("others", "after", "before")]
        start = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
        return cls(t["w"].to_numpy(), start, *(x.flatten().to_numpy() for x in lists))

    def shares(self, i: int, label: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, float]:
        """The word's followers and predecessors by class, and its repetitions."""
        s = slice(self.start[i], self.start[i + 1])
        cls, n = label[self.other[s]], self.after[s]
        out = np.bincount(cls, weights=n, minlength=total)
        into = np.bincount(cls, weights=self.before[s], minlength=total)
        return out, into, float(n[self.other[s] == self.word[i]].sum())


def exchange(links: DataFrame, n_words: int, classes: int = CLASSES, rounds: tuple[int, ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each frequent word, class bigrams) by distributed exchange.

    "Another word" and "end" have classes of their own, which take no words. In a round one of n hashed
    parts of the words moves, n as in ``rounds``, each of ``TASKS`` tasks moving its share in turn; so few
    words move without knowledge of each other, and no task reads more than its share of the links.
    """
    total = classes + 2
    label = np.concatenate([np.arange(n_words) % classes, [classes, classes + 1]]).astype(np.int64)

    def bigrams(now: np.ndarray) -> np.ndarray:
        def run(batches):
            rows = _Links.of(batches)
            if rows is not None:
                first = np.repeat(now[rows.word], np.diff(rows.start))
                g = np.bincount(first * total + now[rows.other], weights=rows.after, minlength=total * total)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total)), pa.array(g)], ["cell", "n"])

        g = np.zeros(total * total)
        for r in links.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            g[r.cell] = r.n
        return g.reshape(total, total)

    def moved(now: np.ndarray, g: np.ndarray, part: int, parts: int) -> np.ndarray:
        def run(batches):
            rows = _Links.of(batches)
            if rows is None:
                return
            mine, counts = now.copy(), g.copy()
            for i in np.argsort(rows.word).tolist():
                w = int(rows.word[i])
                if w >= n_words or turn[w] % parts != part:
                    continue
                out, into, loops = rows.shares(i, mine, total)
                old = int(mine[w])
                new = best_move(out, into, loops, old, counts, classes)
                if new != old:
                    counts[old] -= out
                    counts[:, old] -= into
                    counts[old, old] += loops
                    out[old] -= loops
                    into[old] -= loops
                    counts[new] += out
                    counts[:, new] += into
                    counts[new, new] += loops
                    mine[w] = new
            own = rows.word[rows.word < n_words]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mine[own])], ["w", "c"])

        new = now.copy()
        for r in dealt.mapInArrow(run, "w long, c long").collect():
            new[r.w] = r.c
        return new

    turn = X.mix(np.arange(n_words, dtype=np.uint64)) >> np.uint64(32)
    dealt = checkpoint(links.repartition(TASKS, F.col("w")))
    seen: dict[int, int] = {}
    for parts in rounds if n_words else ():
        part = seen[parts] = seen.get(parts, -1) + 1
        label = moved(label, bigrams(label), part % parts, parts)
    return label, bigrams(label)


def _log_transitions(g: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log10 of the class transitions, with the class distribution as prior; rows sum to one."""
    share = (g.sum(0) + 0.5) / (g.sum() + 0.5 * len(g))
    return np.log10((g + prior * share) / (g.sum(1, keepdims=True) + prior))


def votes(segments: DataFrame, words: np.ndarray, label: np.ndarray, g: np.ndarray, classes: int = CLASSES) -> DataFrame:
    """(key, class, n): the class of each training word in each segment, and its count there.

    Frequent words have theirs. Another word takes the class under which its neighbours there, as
    far as they are frequent words or ends, are likeliest.
    """
    other, end = len(words), len(words) + 1
    logs = _log_transitions(g[np.ix_([*range(classes), classes + 1], [*range(classes), classes + 1])]).astype(np.float32)
    size = np.log10(np.maximum(g.sum(1)[:classes], 1) / max(g.sum(), 1)).astype(np.float32)
    # By the class number of a neighbour: scores for each class; none from "another word".
    before = np.zeros((classes + 2, classes), np.float32)
    after = np.zeros((classes + 2, classes), np.float32)
    before[:classes], before[classes + 1] = logs[:classes, :classes] - size, logs[classes, :classes] - size
    after[:classes], after[classes + 1] = logs[:classes, :classes].T, logs[:classes, classes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            s = Segment.of(r)
            number = _numbers(s.keys, words, other)
            best = label[number].copy()
            text, a, b = s.stream(number, end)
            _, _, local = s.stream(np.arange(len(s.keys)), -1)
            follow = np.append(b[1:], end)
            at = np.flatnonzero((b == other) & ~s.held[text])
            at = at[np.argsort(local[at], kind="stable")]
            who, start = np.unique(local[at], return_index=True)
            start = np.append(start, len(at))
            step = 4096
            for lo in range(0, len(who), step):
                hi = min(lo + step, len(who))
                part = at[start[lo] : start[hi]]
                points = before[label[a[part]]] + after[label[follow[part]]]
                best[who[lo:hi]] = np.argmax(np.add.reduceat(points, start[lo:hi] - start[lo], axis=0) + size, axis=1)
            some = np.flatnonzero(s.trained)
            for lo in range(0, len(some), 1 << 18):
                i = some[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys[i].view(np.int64)), pa.array(best[i].astype(np.int32)), pa.array(s.trained[i])], ["key", "class", "n"])

    return segments.drop("doc").mapInArrow(run, "key long, class int, n long")


def vocabulary(voted: DataFrame) -> DataFrame:
    """(key, n, class): every training word once, with the class that most of its words vote for."""
    per_class = voted.groupBy("key", "class").agg(F.sum("n").alias("n"))
    return per_class.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("class", F.struct("n", -F.col("class"))).alias("class"))


class Totals(NamedTuple):
    """Counts over the training words, ends included: all, distinct, and by class."""

    words: int
    distinct: int
    in_class: np.ndarray
    kinds: np.ndarray


def totals(words: DataFrame, ends: int, classes: int) -> Totals:
    n, kinds = np.zeros(classes + 1), np.zeros(classes + 1)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        n[r["class"]], kinds[r["class"]] = r.n, r.k
    n[classes], kinds[classes] = ends, int(ends > 0)
    return Totals(int(n.sum()), int(kinds.sum()), n, kinds)


DOCS = "n_tokens long, n_known long, base_score double, emission double, cells binary, held_out boolean"


def _measure(s: Segment, count: np.ndarray, cls: np.ndarray, t: Totals, classes: int, ends: int) -> dict[str, list]:
    """Per text: counts, base score, log10 emissions, and how often each class follows each.

    Up to 250 classes fit. Cells are (before * (classes + 2) + this) as uint16 and their counts as int32; ``classes + 1``
    stands for a word that training has not seen.
    """
    wide = classes + 2
    base = np.log10((count + DELTA) / (t.words + DELTA * (t.distinct + 1)))
    known = np.minimum(cls, classes)
    emit = np.where(cls <= classes, np.log10((count + DELTA) / (t.in_class[known] + DELTA * (t.kinds[known] + 1))), 0.0)
    end_base = np.log10((ends + DELTA) / (t.words + DELTA * (t.distinct + 1)))
    end_emit = np.log10((ends + DELTA) / (ends + DELTA * (t.kinds[classes] + 1)))
    n = len(s.length)
    text, _, this = s.stream(cls.astype(np.int64), classes)
    # A word of no class leaves the class before it in force.
    place = np.arange(len(this))
    last = np.maximum.accumulate(np.where(this <= classes, place, -1))
    before = np.concatenate([[classes], np.where(last >= 0, this[np.maximum(last, 0)], classes)[:-1]])
    owner = np.repeat(np.arange(n), s.length)
    pair = (text * wide + before) * wide + this
    cells, times = np.unique(pair, return_counts=True)
    at = X.bounds(cells // (wide * wide), n)
    code = (cells % (wide * wide)).astype(np.uint16)
    times = times.astype(np.int32)
    return {
        "n_tokens": s.length + 1,
        "n_known": np.bincount(owner, weights=count[s.words] > 0, minlength=n).astype(np.int64) + int(ends > 0),
        "base_score": np.bincount(owner, weights=base[s.words], minlength=n) + end_base,
        "emission": np.bincount(owner, weights=emit[s.words], minlength=n) + end_emit,
        "cells": [code[at[i] : at[i + 1]].tobytes() + times[at[i] : at[i + 1]].tobytes() for i in range(n)],
        "held_out": s.held,
    }


def _cells(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 6
    return np.frombuffer(blob[: 2 * n], np.uint16), np.frombuffer(blob[2 * n :], np.int32)


def score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rate: float = RATE, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``held`` is a condition; the model learns from the rows where it is false. A null text is empty:
    one token, its end. Repeated rows are texts of their own. Without training rows every word is
    unknown and both scores are those of uniform smoothing.
    """
    if not 0 < classes <= MOST_CLASSES:
        raise ValueError(f"classes must be 1 to {MOST_CLASSES}")
    spark = docs.sparkSession
    ship(spark)
    segments = stored(encode(docs, id_col, text_col, held), "segments", **LAYOUT)
    words = frequent(segments, rate)
    label, g = exchange(adjacency(segments, words), len(words), classes, rounds)
    known = stored(vocabulary(votes(segments, words, label, g, classes)), "vocabulary")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int((~np.frombuffer(r["held"], bool)).sum())])], ["n"])

    n_ends = segments.select("held").mapInArrow(ends, "n long").agg(F.sum("n")).first()[0] or 0
    t = totals(known, n_ends, classes)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            k = np.frombuffer(r["keys"], np.uint64).view(np.int64)
            for lo in range(0, len(k), 1 << 18):
                part = k[lo : lo + (1 << 18)]
                slot = (r["segment"] << PLACE_BITS) + np.arange(lo, lo + len(part))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(part)], ["slot", "key"])

    wanted = segments.select("segment", "keys").mapInArrow(keys, "slot long, key long")
    told = wanted.join(known, "key").select("slot", F.expr("n * 256 + class").alias("fact"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def measure(key, seg: pa.Table, info: pa.Table) -> pa.Table:
        r = _row(seg.combine_chunks().to_batches()[0], 0)
        s = Segment.of(r)
        count = np.zeros(len(s.keys), dtype=np.int64)
        cls = np.full(len(s.keys), classes + 1, dtype=np.int64)
        place = info["slot"].to_numpy() & ((1 << PLACE_BITS) - 1)
        fact = info["fact"].to_numpy()
        count[place], cls[place] = fact >> 8, fact & 255
        cols = _measure(s, count, cls, t, classes, n_ends)
        with pa.ipc.open_stream(r["doc"]) as f:
            ids = f.read_all()["id"].combine_chunks()
        return pa.table({id_col: ids, **{k: pa.array(v) for k, v in cols.items()}})

    facts = told.groupBy(F.shiftright("slot", PLACE_BITS).alias("segment"))
    measured = stored(segments.groupBy("segment").cogroup(facts).applyInArrow(measure, f"`{id_col}` {id_type}, {DOCS}"), "measures")
    wide = classes + 2

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(wide * wide)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                code, n = _cells(blob)
                g[code] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide * wide)), pa.array(g)], ["cell", "n"])

    table = np.zeros(wide * wide)
    for r in measured.filter(~F.col("held_out")).select("cells").mapInArrow(transitions, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r.cell] = r.n
    seen = table.reshape(wide, wide)[: classes + 1, : classes + 1]
    logs = np.zeros((wide, wide))
    logs[: classes + 1, : classes + 1] = _log_transitions(seen)
    # An unseen word: each class holds back the smoothing share of one word.
    back = DELTA / (t.in_class + DELTA * (t.kinds + 1))
    logs[: classes + 1, classes + 1] = np.log10((10 ** logs[: classes + 1, : classes + 1] * back).sum(1))
    flat = logs.ravel()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = np.array([flat[c] @ n for c, n in map(_cells, batch.column("cells").to_pylist())], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), batch.column("held_out"), batch.column("n_tokens"), batch.column("n_known"),
                pa.array(np.full(batch.num_rows, t.words)), batch.column("base_score"), pa.array(batch.column("emission").to_numpy() + extra),
            ], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return measured.mapInArrow(finish, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
