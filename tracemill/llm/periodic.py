"""Runs of repeated words, found by minimizers at doubling scales.

At scale S every position has a key of the S words from it on, and the least key of each window of
S/2 positions marks a minimizer. Inside a run of period q, S/2 < q <= S, of at least four periods two
windows lie that are q apart and read the same words: both their minimizers are marked. Equal keys
within the run are a multiple of q apart, as S >= q, so the two are neighbours among the positions of
their key. Neighbours of a distance in that range are therefore the seeds of all runs of the scale;
each is extended word by word to both sides. Periods of up to ``DIRECT`` words are read directly: for
each lag, the stretches in which a word equals the one a lag further on.

The texts of a batch are laid out one behind the other, with a mark of its own after each, so all
steps but the extension of seeds are array operations over many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracemill.llm import ship
from tracemill.llm.text import groups, mix, utf8

DIRECT = 8
PERIODS = 4  # a run has at least so many periods,
LEAST = 6  # and so many words
BYTES = 1 << 20  # texts that are laid out together, or one longer text
_PAIR = np.uint64(0xD6E8FEB86659FD93)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _least(period: int) -> int:
    return max(LEAST, PERIODS * period)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of maximal stretches of set flags."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least value of each window of ``w`` places, from running minima of blocks to both sides."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, x.max(), x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def minimizers(key: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the least key of some window of ``w`` places; all of them, if several tie."""
    if len(key) < w:
        return np.zeros(0, np.int64)
    least = _window_least(key, w)
    # A place is marked if the greatest of the minima of its windows is its own key.
    rim = np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)
    return np.flatnonzero(~_window_least(np.concatenate([rim, ~least, rim]), w) == key)


def seeds(key: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): neighbouring minimizers of equal key, half a scale to a scale apart."""
    at = minimizers(key, scale // 2)
    order = at[np.argsort(key[at], kind="stable")]
    near, far = order[:-1], order[1:]
    apart = far - near
    fit = (key[near] == key[far]) & (apart > scale // 2) & (apart <= scale)
    return near[fit], apart[fit]


def _extend(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which each word equals the one ``lag`` further on."""
    hi, step, limit = at, 64, len(x) - lag
    while hi < limit:
        stop = min(hi + step, limit)
        differ = x[hi:stop] != x[hi + lag : stop + lag]
        k = int(differ.argmax())
        if differ[k]:
            hi += k
            break
        hi, step = stop, min(2 * step, 1 << 16)
    lo, step = at, 64
    while lo > 0:
        stop = max(lo - step, 0)
        differ = (x[stop:lo] != x[stop + lag : lo + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            lo -= k
            break
        lo, step = stop, min(2 * step, 1 << 16)
    return lo, hi


def find_runs(x: np.ndarray, longest: int, direct: int = DIRECT) -> np.ndarray:
    """Rows (start, length, least period) of all runs in ``x``, sorted; equal numbers are equal words.

    No run is longer than ``longest``.
    """
    found: dict[tuple[int, int], int] = {}  # A stretch has one least period, which comes first.
    for lag in range(1, min(direct, longest // PERIODS) + 1):
        lo, hi = _stretches(x[:-lag] == x[lag:])
        long = hi - lo >= _least(lag) - lag
        for a, b in zip(lo[long].tolist(), hi[long].tolist()):
            found.setdefault((a, b + lag), lag)
    key, size, scale = mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, 2 * direct
    while (scale // 2 + 1) * PERIODS <= longest:
        while size < scale:
            key = mix(key[:-size] * _PAIR + key[size:])
            size *= 2
        place, lag = seeds(key, scale)
        # A run goes on for as long as the scale's quarter to one side at least; its last word there decides.
        rest = (lag * (PERIODS - 1) - scale + 1) // 2
        ahead, back = np.minimum(place + scale - 1 + rest, len(x) - 1 - lag), np.maximum(place - rest, 0)
        fit = (x[ahead] == x[ahead + lag]) | (x[back] == x[back + lag])
        place, lag = place[fit], lag[fit]
        order = np.lexsort((place, lag))
        last, end = 0, 0
        for at, d in zip(place[order].tolist(), lag[order].tolist()):
            if d == last and at < end:
                continue
            a, b = _extend(x, at, d)
            last, end = d, b
            if b - a >= _least(d) - d:
                found.setdefault((a, b + d), d)
        scale *= 2
    return np.array(sorted((a, b - a, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every whole text.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch of words of
    least period ``period`` that has four periods and six words at least and cannot be made longer;
    ``runs`` has all of them by start, then period. ``collapsed`` joins by one space the words that no
    run holds after its first period. A null, empty or blank text has no words, no runs and an empty
    ``collapsed``. Repeated rows give repeated rows, null ids stay; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            whole = memoryview(data)
            for lo, hi in groups(offsets, BYTES):
                cuts = offsets[lo : hi + 1].tolist()
                words = [bytes(whole[a:b]).split() for a, b in zip(cuts, cuts[1:])]
                n = np.array([len(w) for w in words], dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(n + 1)])  # a mark follows each text
                x = np.empty(first[-1], np.int64)
                marks = first[1:] - 1
                is_word = np.ones(len(x), dtype=bool)
                is_word[marks] = False
                flat = pa.array([w for part in words for w in part], pa.binary())
                x[is_word] = flat.dictionary_encode().indices.to_numpy()
                x[marks] = -1 - np.arange(hi - lo)
                found = find_runs(x, int(n.max()))
                owner = np.searchsorted(first, found[:, 0], side="right") - 1
                depth = np.zeros(len(x) + 1, np.int64)
                np.add.at(depth, found[:, 0] + found[:, 2], 1)
                np.add.at(depth, found[:, 0] + found[:, 1], -1)
                keep = np.cumsum(depth)[:-1] == 0
                dropped = np.bincount(owner, minlength=hi - lo)
                lines = [
                    b" ".join(compress(w, keep[a : a + len(w)].tolist()) if d else w)
                    for w, a, d in zip(words, first.tolist(), dropped.tolist())
                ]
                parts = pa.StructArray.from_arrays(
                    [pa.array(found[:, 0] - first[owner]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"]
                )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(dropped)]), pa.int32()), parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), lists, pc.cast(pa.array(lines, pa.binary()), pa.string())],
                    [id_col, "n_words", "runs", "collapsed"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string")
