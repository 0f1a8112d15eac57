"""Byte-level BPE by a queue of merge ranks under a hierarchy of bitmaps.

Pre-tokens are linked lists of tokens, many of them laid out in one array. Each rank of the vocabulary
has a bucket with the places whose token and the next one make that rank's token; a bitmap has one bit
per bucket that holds something, and a bitmap above it one bit per word of the first that is not zero.
The lowest set bit of both names the rank to merge next. Pre-tokens do not touch each other, so one
queue serves all of them. An entry whose place no longer makes its rank is stale and skipped, so a
merge removes nothing from other buckets, and n bytes cost a number of steps in proportion to n,
however long the pre-token.

Within a rank the leftmost place goes first. A bucket of many places is merged by array operations:
of neighbours that share a token every other one is merged, as from left to right. That would be wrong
only if a merge made a pair of the same or a lower rank, which has to go before the places further
right; pre-tokens where that happens are merged again one place at a time.

The bytes of a token alone decide which ranks it can make, so all pairs that merge are listed when the
vocabulary is loaded: every cut of every token into two tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracemill.llm import ship

WORD_BITS = 8  # a word of the lower bitmap has 2**WORD_BITS bits
MANY = 24  # places of a bucket from which on array operations merge it
GROUP = 4 << 20  # bytes of texts whose pre-tokens are merged together, or one longer text
CACHED = 1 << 18  # pre-tokens whose ids a Python worker keeps before it begins anew,
CACHED_CHARS = 1 << 23  # and their characters
WHOLE = 1 << 20  # pre-tokens of longer texts are not held in one list


class Vocabulary:
    """Ranks of byte strings; ranks are the ids. Every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.base = self.size + 1  # the id ``size`` stands between pre-tokens and makes nothing
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    self.pairs[a * self.base + b] = rank
        codes = np.array(sorted(self.pairs), np.int64)
        self._codes = np.append(codes, np.iinfo(np.int64).max)
        self._made = np.array([*map(self.pairs.__getitem__, codes.tolist()), -1], np.int32)
        self._buckets: list[list[int]] = [[] for _ in range(self.size)]
        self._words = [0] * ((self.size >> WORD_BITS) + 1)

    def _makes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks that pairs of tokens make, -1 for none."""
        code = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self._codes, code)
        return np.where(self._codes[at] == code, self._made[at], np.int32(-1))

    def merge(self, pieces: list[bytes], many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after the other, and how many each has."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        length = np.array([len(p) for p in pieces], np.int64)
        # Place 0 and the place behind each pre-token hold the separator.
        ends = np.cumsum(length + 1)
        n = int(ends[-1]) + 1
        inner = np.ones(n, dtype=bool)
        inner[0] = False
        inner[ends] = False
        ids = np.full(n, self.size, np.int32)
        ids[inner] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        known = [(i, self.ranks[p]) for i, p in enumerate(pieces) if p in self.ranks]
        for i, rank in known:  # a pre-token of the vocabulary is that token
            ids[ends[i] - length[i] : ends[i]] = -1
            ids[ends[i] - length[i]] = rank
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        makes = np.append(self._makes(ids[:-1], ids[1:]), np.int32(-1))
        for i, _ in known:
            makes[ends[i] - length[i] - 1 : ends[i]] = -1
        again = self._run(ids, after, before, makes, many)
        alive = (ids >= 0) & inner
        total = np.concatenate([[0], np.cumsum(alive)])
        count = total[ends] - total[ends - length]
        out = ids[alive].astype(np.uint32)
        if not len(again):
            return out, count
        parts = np.split(out, np.cumsum(count)[:-1])
        for i in np.unique(np.searchsorted(ends, again)).tolist():
            parts[i], count[[i]] = self.merge([pieces[i]], many=n + 1)
        return np.concatenate(parts), count

    def _run(self, ids: np.ndarray, after: np.ndarray, before: np.ndarray, makes: np.ndarray, many: int) -> np.ndarray:
        """Merge until no pair makes a token; places of pre-tokens whose order cannot be trusted."""
        buckets, words, top = self._buckets, self._words, 0
        mask, base, rank_of = (1 << WORD_BITS) - 1, self.base, self.pairs.get
        ids1, after1, before1, makes1 = map(memoryview, (ids, after, before, makes))
        doubt: list[np.ndarray] = []
        # The places of the beginning stay in one array, by rank; buckets hold those that come later.
        first = np.flatnonzero(makes >= 0).astype(np.int32)
        first = first[np.argsort(makes[first], kind="stable")]
        ranks, start = np.unique(makes[first], return_index=True)
        begun = dict(zip(ranks.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(first)])))
        for r in begun:
            words[r >> WORD_BITS] |= 1 << (r & mask)
            top |= 1 << (r >> WORD_BITS)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = high << WORD_BITS | low.bit_length() - 1
            bucket, buckets[rank] = buckets[rank], []
            words[high] = word ^ low
            if word == low:
                top ^= 1 << high
            lo, hi = begun.pop(rank, (0, 0))
            if len(bucket) + hi - lo >= many:
                i = np.unique(np.concatenate([first[lo:hi], np.array(bucket, np.int32)])) if bucket else first[lo:hi]
                i = i[makes[i] == rank]
                j = after[i]
                shared = np.concatenate([[False], i[1:] == j[:-1]])
                if shared.any():
                    turn = np.arange(len(i))
                    even = (turn - np.maximum.accumulate(np.where(shared, 0, turn))) % 2 == 0
                    i, j = i[even], j[even]
                k = after[j]
                met = ids[k]
                ids[i], ids[j], makes[j], after[i], before[k] = rank, -1, -1, k, i
                h = before[i]
                right, left = self._makes(ids[i], ids[k]), self._makes(ids[h], ids[i])
                makes[i], makes[h] = right, left
                early = self._makes(ids[i], met)  # the pair there was before the next place merged too
                risky = np.concatenate([i[(made >= 0) & (made <= rank)] for made in (right, early)] + [h[(left >= 0) & (left <= rank)]])
                if len(risky):
                    doubt.append(risky)
                for r, place in zip(np.concatenate([right, left]).tolist(), np.concatenate([i, h]).tolist()):
                    if r >= 0:
                        if not buckets[r]:
                            words[r >> WORD_BITS] |= 1 << (r & mask)
                            top |= 1 << (r >> WORD_BITS)
                        buckets[r].append(place)
                continue
            bucket += first[lo:hi].tolist()
            bucket.sort()
            while bucket:
                i = heappop(bucket)
                if makes1[i] != rank:
                    continue
                j = after1[i]
                k = after1[j]
                ids1[i] = rank
                ids1[j] = makes1[j] = -1
                after1[i] = k
                before1[k] = i
                h = before1[i]
                makes1[i] = right = rank_of(rank * base + ids1[k], -1)
                makes1[h] = left = rank_of(ids1[h] * base + rank, -1)
                lower = False
                for r, place in ((right, i), (left, h)):
                    if r == rank:
                        heappush(bucket, place)
                    elif r >= 0:
                        if not buckets[r]:
                            words[r >> WORD_BITS] |= 1 << (r & mask)
                            top |= 1 << (r >> WORD_BITS)
                        buckets[r].append(place)
                        lower |= r < rank
                if lower and bucket:  # the rest waits for the lower rank
                    buckets[rank] = bucket
                    words[high] |= low
                    top |= 1 << high
                    break
        return np.concatenate(doubt) if doubt else np.zeros(0, np.int32)


def _ranges(codes: list[int]) -> str:
    """Rising code points as ranges of a character class."""
    ends = [i for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip([0, *(e + 1 for e in ends)], ends))


def odd_characters() -> dict[str, str]:
    """Characters whose class differs between the pattern library here and the one the ranks are
    written for, which may follow another edition of Unicode, and one of the right class for each."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    plain = {bytes([b]): b for b in range(256)}
    swap: dict[str, str] = {}
    for name, member in ((r"\p{L}", "é"), (r"\p{N}", "٣"), (r"\s", " ")):
        encoder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=plain, special_tokens={})
        theirs = set(encoder.encode_to_numpy(every).astype(np.uint8).tobytes().decode())
        ours = set(regex.findall(name, every))
        swap |= {c: swap.get(c, "☃") for c in ours - theirs} | {c: member for c in theirs - ours}
    return swap


class Splitter:
    """Matches of a pattern; odd characters stand as others of the right class for the match alone."""

    def __init__(self, pattern: str, odd: dict[str, str]):
        import re

        import regex

        self._swap = str.maketrans(odd)
        self._odd = re.compile(f"[{_ranges(sorted(map(ord, odd)))}]") if odd else None
        self._pattern = regex.compile(pattern)

    def pieces(self, text: str) -> Iterable[str]:
        if self._odd is not None and not text.isascii() and self._odd.search(text):
            return (text[m.start() : m.end()] for m in self._pattern.finditer(text.translate(self._swap)))
        if len(text) > WHOLE:
            return (m[0] for m in self._pattern.finditer(text))
        return self._pattern.findall(text)


class _Numbers(dict):
    """A serial number for each new key."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of texts; the ids of pre-tokens met before are kept."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, odd: dict[str, str]):
        self.vocabulary, self.splitter = vocabulary, Splitter(pattern, odd)
        self._forget()

    def _forget(self) -> None:
        self.number, self.chars = _Numbers(), 0
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pre-tokens that are new are merged together."""
        if len(self.number) > CACHED or self.chars > CACHED_CHARS:
            self._forget()
        known = len(self.number)
        number = self.number.__getitem__
        met = [np.fromiter(map(number, self.splitter.pieces(t)), np.int32) for t in texts]
        fresh = list(islice(self.number, known, None))
        ids, count = self.vocabulary.merge([p.encode() for p in fresh])
        self.chars += sum(map(len, fresh))
        self.ids = ids = np.concatenate([self.ids, ids])
        self.start = start = np.concatenate([self.start, self.start[-1] + np.cumsum(count)])
        found = []
        for m in met:
            lo, n = start[m], start[m + 1] - start[m]
            end = np.cumsum(n)
            found.append(ids[np.repeat(lo - end + n, n) + np.arange(end[-1] if len(end) else 0)])
        return found


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A file of lines "base64 of the token's bytes, its rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


_encoders: dict[tuple[str, str], Encoder] = {}


def load_encoder(path: str, pattern: str, odd: dict[str, str]) -> Encoder:
    """One encoder per Python worker, file and pattern."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary(load_ranks(path)), pattern, odd)
    return _encoders[path, pattern]


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``GROUP`` bytes in a column, or one larger row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + GROUP, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every whole text; ``ids`` are little-endian unsigned 32-bit numbers.

    Each match of ``pattern`` is merged on its own; there are no special tokens, so their strings are
    ordinary text. A null or empty text has no tokens. Repeated rows give repeated rows, null ids stay;
    other columns are not read. ``vocabulary`` must exist on every executor.
    """
    ship(docs.sparkSession)
    odd = odd_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(vocabulary, pattern, odd)
        for whole in batches:
            for batch in _groups(whole, 1):
                ids = encoder.encode(pc.fill_null(batch.column(1), "").to_pylist())
                n = pa.array([len(x) for x in ids], pa.int64())
                packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, packed], [id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, decoded) of what ``encode`` gives; ``decoded`` are the bytes of the ids.

    Null ids count as none. An id that the vocabulary lacks is an error.
    """
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: piece for piece, rank in load_ranks(vocabulary).items()}
        for whole in batches:
            for batch in _groups(whole, 2):
                packed = pc.fill_null(batch.column(2), b"").to_pylist()
                bodies = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in packed]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary())], [id_col, "n_tokens", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
