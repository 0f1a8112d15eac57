"""Alignment of the tokens of two tokenizers by coalescing their byte intervals.

The tokens of both are half-open byte ranges. Sorted by start, they fall into groups: a new group
begins where a start reaches the running maximum of the ends before it, which is where tokens of both
sides end together. Within a group each token of the first meets a contiguous range of tokens of the
second; these pairs are the links. Texts are laid out behind each other, so one pass serves a batch.

How many documents hold a linked pair of ids is a fact of the corpus. Documents are encoded once, into
segments. A segment counts its pairs by document before the shuffle, asks for the facts of its distinct
pairs by a join, and its links are then read from the stored ids again, which costs a sort and no
tokenizer. So nothing larger than a segment or the facts of its pairs meets in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm import ship, stored
from tracemill.llm.packing import _encoder, token_ids

SEGMENT = 2 << 20  # bytes of the texts of a segment, or one longer text
ROWS = 256

STATISTICS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Side(NamedTuple):
    """What the tokens of one tokenizer stand for: their bytes, and the ids of texts."""

    length: np.ndarray
    token: list[bytes]
    encode: Callable[[list[str]], list[np.ndarray]]
    names: list[list[str]]


def _names(size: int) -> list[list[str]]:
    """Ids as decimals, each with the sign that may follow: within a side, between sides, between groups."""
    return [[f"{i}{sign}" for i in range(size)] for sign in ",|;"]


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level BPE file; a space goes before each text, special strings are plain text."""
    import tiktoken

    read = _encoder.__wrapped__(path)
    ranks = read._mergeable_ranks
    plain = tiktoken.Encoding("plain", pat_str=read._pat_str, mergeable_ranks=ranks, special_tokens={})
    del read
    token = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        token[rank] = piece

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [token_ids(plain, " " + t) for t in texts]

    return Side(np.array([len(t) for t in token], np.int64), token, encode, _names(len(token)))


@lru_cache(maxsize=2)
def sentence_piece(path: str) -> Side:
    """A sentencepiece model, which puts a space before each text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    token = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        token.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids) for ids in model.encode(texts, num_threads=1, return_type="numpy")] if texts else []

    return Side(np.array([len(t) for t in token], np.int64), token, encode, _names(len(token)))


def both(a: Side, b: Side, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids of each text by both sides; none where a side's bytes are not the space and the text."""
    out, none = [], np.zeros(0, np.int64)
    for t, x, y in zip(texts, a.encode(texts), b.encode(texts)):
        want = b" " + t.encode()
        same = t and all(s.length[ids].sum() == len(want) and b"".join(map(s.token.__getitem__, ids.tolist())) == want for s, ids in ((b, y), (a, x)))
        out.append((x, y) if same else (none, none))
    return out


class Links(NamedTuple):
    """Tokens in groups and their links, over texts that are laid out behind each other."""

    a_group: np.ndarray
    b_group: np.ndarray
    a: np.ndarray  # place of the first side's token of each link
    b: np.ndarray


def coalesce(a_length: np.ndarray, b_length: np.ndarray) -> Links:
    """Groups and links of two rows of tokens that cover the same bytes."""
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    a_start, b_start = a_end - a_length, b_end - b_length
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((start,))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), dtype=bool)
    new[1:] = start[order[1:]] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    # Overlaps: from the first token of b that ends behind the start, to the last that starts before the end.
    lo = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - lo
    a = np.repeat(np.arange(len(n)), n)
    b = np.arange(len(a)) + np.repeat(lo - np.cumsum(n) + n, n)
    return Links(group[: len(a_end)], group[len(a_end) :], a, b)


def pack_ids(ids: np.ndarray, side: Side) -> bytes:
    """Little-endian unsigned ids of the fewest bytes that the vocabulary allows: 16 or 32 bits."""
    return ids.astype(_width(side)).tobytes()


def _width(side: Side) -> str:
    return "<u2" if len(side.token) <= 1 << 16 else "<u4"


class Laid:
    """The ids of several documents behind each other, and where each document begins."""

    def __init__(self, a: Side, b: Side, a_ids: list[bytes], b_ids: list[bytes]):
        self.sides = a, b
        self.a, self.a_first = self._lay(a, a_ids)
        self.b, self.b_first = self._lay(b, b_ids)
        self.links = coalesce(a.length[self.a], b.length[self.b])

    @staticmethod
    def _lay(side: Side, column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        width = _width(side)
        first = np.cumsum([0, *(len(x) // np.dtype(width).itemsize for x in column)])
        return np.frombuffer(b"".join(column), width).astype(np.int64), first

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair of ids, document, links): the distinct pairs of each document, by pair."""
        links, n = self.links, len(self.a_first) - 1
        owner = np.repeat(np.arange(n), np.diff(self.a_first))
        pair = self.a[links.a] * len(self.sides[1].token) + self.b[links.b]
        code = np.sort(pair * max(n, 1) + owner[links.a])
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        each = code[at]
        return each // max(n, 1), each % max(n, 1), np.diff(np.append(at, len(code)))

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document: the ids of both sides, group by group."""
        links, (a, b) = self.links, self.sides
        ids, group = np.concatenate([self.a, self.b]), np.concatenate([links.a_group, links.b_group])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.lexsort((2 * group + side,))
        ids, group, side = ids[order], group[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)[: len(ids)]
        sign = np.where(last, 1 + side, 0)
        names = [t for s in (a, b) for t in s.names]
        size = [len(t) for t in names]
        place = np.concatenate([[0], np.cumsum(size)])[3 * side + sign] + ids
        table = _joined(a.names, b.names)
        edge = (self.a_first + self.b_first).tolist()
        return ["".join(map(table.__getitem__, place[p:q].tolist()))[:-1] for p, q in zip(edge, edge[1:])]


_tables: dict[tuple[int, int], list[str]] = {}


def _joined(a: list[list[str]], b: list[list[str]]) -> list[str]:
    key = id(a), id(b)
    if key not in _tables:
        _tables.clear()
        _tables[key] = [t for names in (*a, *b) for t in names]
    return _tables[key]


def encode_both(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(segment, id, a, b): the ids of both tokenizers, packed.

    A segment holds texts of one task of about ``segment`` bytes. Null and empty texts, and texts that
    a tokenizer does not keep byte by byte, have no tokens on either side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(byte_path), sentence_piece(piece_path)
        number, filled = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                names = []
                for n in pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist():
                    if filled and filled + n > segment:
                        number, filled = number + 1, 0
                    filled += n
                    names.append(number)
                ids = both(a, b, pc.fill_null(batch.column(1), "").to_pylist())
                packed = [pa.array([pack_ids(x[i], side) for x in ids], pa.binary()) for i, side in enumerate((a, b))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(0), *packed], ["segment", id_col, "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"segment long, `{id_col}` {kind}, a binary, b binary")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(id, ``STATISTICS``): how the tokens of two tokenizers lie over each whole text.

    ``groups`` names the ids of both sides group by group (see ``group_texts``); a link is a pair of
    tokens that share a byte. The count of a pair of ids is the number of documents that hold it
    linked; ``n_best`` are the links whose count is the highest of their first id, ties included,
    ``count_sum`` is the sum of the counts over links. Texts that are null, empty, or not kept byte by
    byte by both tokenizers have zeros and an empty ``groups``. Each of repeated rows is a document of
    its own; null ids stay; other columns are not read. Both files must exist on every executor.
    """
    spark = docs.sparkSession
    ship(spark)
    encoded = stored(encode_both(docs, byte_path, piece_path, id_col, text_col, segment), "aligned")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                laid = Laid(byte_level(byte_path), sentence_piece(piece_path), *(whole.column(c).slice(lo, hi - lo).to_pylist() for c in (1, 2)))
                held, n = np.unique(laid.pairs()[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), names[lo])), pa.array(held), pa.array(n)], ["segment", "pair", "n"])

    # Each distinct pair of a segment once, or twice where a batch ends within the segment.
    asked = stored(encoded.select("segment", "a", "b").mapInArrow(count, "segment long, pair long, n long"), "aligned-pairs")
    pieces = len(sentence_piece(piece_path).token)
    total = asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {pieces}"))
    # A first id has at most as many rows as the second vocabulary has pieces.
    total = total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))).select("pair", "n", "best")
    facts = asked.select("segment", "pair").join(total, "pair")
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        laid = Laid(byte_level(byte_path), sentence_piece(piece_path), rows["a"].to_pylist(), rows["b"].to_pylist())
        pair, doc, links = laid.pairs()
        known = told["pair"].to_numpy()
        # The facts are those of just these pairs, some twice; both sorted, they meet by rank.
        known, first = np.unique(known, return_index=True)
        at = np.cumsum(np.append(False, pair[1:] != pair[:-1])[: len(pair)])
        n, best = told["n"].to_numpy()[first], told["best"].to_numpy(zero_copy_only=False)[first]
        if not np.array_equal(known[at], pair):
            raise ValueError("the facts of a segment are not those of its pairs")
        sums = [np.zeros(rows.num_rows, np.int64) for _ in range(3)]
        for total, value in zip(sums, (links, links * best[at], links * n[at])):
            np.add.at(total, doc, value)
        # Groups are numbered over the segment: a document has those up to its last less those before it.
        groups = np.diff(np.append(0, laid.links.a_group + 1)[laid.a_first])
        columns = [np.diff(laid.a_first), np.diff(laid.b_first), groups, *sums, laid.group_texts()]
        names = [c.split()[0] for c in STATISTICS.split(", ")]
        return pa.table({id_col: rows[id_col], **{c: pa.array(v) for c, v in zip(names, columns)}})

    return encoded.groupBy("segment").cogroup(facts.groupBy("segment")).applyInArrow(measure, f"`{id_col}` {kind}, {STATISTICS}")
