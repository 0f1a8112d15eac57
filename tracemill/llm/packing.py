"""Packing of token streams into sequences by Karmarkar-Karp multiway differencing.

A document fills whole sequences as far as it goes; what remains is cut into a few even pieces. A
task gathers pieces until they fill ``GROUP_WINDOWS`` sequences, then differencing deals them out:
each piece begins as a partial partition of its own, and the two partitions with the largest
imbalance are merged, the fullest windows of one with the emptiest of the other, until one is left.
If its fullest window is over capacity, the window count rises and the group is dealt again.

Groups are made where the rows are, so nothing is shuffled and a task holds one group at a time.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracemill.llm import ship

CAPACITY = 1024
GROUP_WINDOWS = 192
PARTS = 3  # pieces that a remainder is cut into, if long enough
LEAST_PART = 32
# A run of white space of this length is cut out of its text: the encoder's pattern matcher stops at a million.
BLANK_RUN = 1 << 16
# The white space of that pattern; that of Python's also has U+001C to U+001F.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _merge(a: list, b: list, k: int) -> list:
    """The fullest windows of ``a`` get the emptiest of ``b``; entries are (size, members), falling."""
    la, lb = len(a), len(b)
    both = la + lb - k
    if both <= 0:
        out = a + b
    else:
        out = a[: la - both]
        out += [(a[i][0] + b[k - 1 - i][0], (a[i][1], b[k - 1 - i][1])) for i in range(la - both, la)]
        out += b[: lb - both]
    out.sort(key=_size, reverse=True)
    return out


def _size(entry: tuple) -> int:
    return entry[0]


def _members(node) -> Iterator[int]:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            yield x


def difference(sizes: list[int], k: int) -> list[tuple[int, object]]:
    """Karmarkar-Karp: ``k`` windows of near-equal size, as (size, tree of item numbers)."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        c = _merge(a, b, k)
        gap = c[0][0] - (c[-1][0] if len(c) == k else 0)
        heapq.heappush(heap, (-gap, serial, c))
        serial += 1
    return heap[0][2] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``, each a list of item numbers; no item may be larger."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        windows = difference(sizes, k)
        if windows[0][0] <= capacity:
            return [sorted(_members(w[1])) for w in windows]
        k += max(1, k // 256)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Packer:
    """Pieces of one task; ``flush`` returns the rows of a packed group."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next = capacity, task << 33
        self.whole: list[tuple] = []
        self.parts: list[tuple] = []
        self.tokens = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        full = n - n % c
        for at in range(0, full, c):
            self.whole.append((doc, at, c, _crc(ids[at : at + c]), n, self.next, 0))
            self.next += 1
        rest = n - full
        if not rest:
            return
        parts = max(1, min(PARTS, rest // LEAST_PART))
        edges = [full + rest * j // parts for j in range(parts + 1)]
        for lo, hi in zip(edges, edges[1:]):
            self.parts.append((doc, lo, hi - lo, _crc(ids[lo:hi]), n))
        self.tokens += rest

    @property
    def ready(self) -> bool:
        return self.tokens > (GROUP_WINDOWS - 1) * self.capacity

    def flush(self) -> list[tuple]:
        rows, self.whole = self.whole, []
        for window in pack([p[2] for p in self.parts], self.capacity):
            at = 0
            for i in window:
                rows.append((*self.parts[i], self.next, at))
                at += self.parts[i][2]
            self.next += 1
        self.parts, self.tokens = [], 0
        return rows


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The ids of a byte-level BPE vocabulary file.

    The file's own ranks go to a faster encoder of the same algorithm and pattern; tests hold the
    ids against the library that the file is written for. Special strings become special ids, as
    that library does by default.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["normalizer"] is None
    if not plain or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"].get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE file")
    # Byte-level files write each byte as a printable character: printable bytes as themselves,
    # the others in turn from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_ids(encoder, text: str, run: int = BLANK_RUN) -> np.ndarray:
    """The ids of a whole text, special strings included.

    A run of white space is one piece up to its last character, which goes with what follows it; a run
    at the end, or before a special string, is one piece as a whole. So runs of at least ``run``
    characters are pieces of their own here, and no pattern has to match them.
    """
    if len(text) < run or not re.search(f"{BLANK}{{{run}}}", text):
        return encoder.encode_to_numpy(text, allowed_special="all")
    special = sorted(encoder.special_tokens_set, key=len, reverse=True)
    found = [np.zeros(0, np.uint32)]
    for i, part in enumerate(re.split(f"({'|'.join(map(re.escape, special))})", text) if special else [text]):
        if i % 2:
            found.append(np.array([encoder.encode_single_token(part)], np.uint32))
            continue
        at = 0
        for m in re.finditer(f"{BLANK}{{{run},}}", part):
            end = m.end() if m.end() == len(part) else m.end() - 1
            found.append(encoder.encode_to_numpy(part[at : m.start()]))
            found.append(np.array(encoder._encode_single_piece(part[m.start() : end]), np.uint32))
            at = end
        found.append(encoder.encode_to_numpy(part[at:]))
    return np.concatenate(found)


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ``PIECES``): every token of every document in exactly one piece of one sequence.

    A document is its token ids and then ``end_id``, so a null or empty text is one token. Repeated
    rows are packed each on its own. Sequences have at most ``capacity`` tokens; ``sequence_id`` is
    unique, ``offset`` has no gaps. Other columns are not read. ``vocabulary`` must exist on every
    executor.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, {PIECES}"
    names = [id_col, *(c.split()[0] for c in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        packer = _Packer(TaskContext.get().partitionId(), capacity)
        id_type = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.flush()))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for doc, text in zip(part.column(0).to_pylist(), pc.fill_null(part.column(1), "").to_pylist()):
                    ids = token_ids(encoder, text)
                    packer.add(doc, np.append(ids, np.uint32(end_id)))
                    if packer.ready:
                        yield rows()
        if packer.parts or packer.whole:
            yield rows()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
