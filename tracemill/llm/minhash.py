"""Near duplicates by ProbMinHash, banding and exact verification.

A text is its weighted shingles. Every shingle sends arrivals of a Poisson process, whose rate is its
weight, to random registers; a register keeps the shingle that arrived first. A text is done when no
shingle can arrive before the latest register any more. Two texts agree in a register with the chance
of their probability Jaccard similarity.

A link may also be plain, without weights, and two texts with the same shingles in other numbers need
not agree in a weighted register. So a text with a repeated shingle has a second set of registers, of
its shingles with a weight of one each; for other texts both sets are the same. Bands of both sets are
alike, and a pair passes the one-bit screen by either.

Texts with the same words are one node. Nodes that share a band of registers are candidates; a link
needs the exact similarity of their shingles. Each node is first compared with one node of its
buckets, the bucket leader that it shares most bands with. Then components are compared: in each
bucket that holds several, one node of each with one of the largest. Only the nodes that are still
in another component than most of their bucket are compared with the others there, in blocks that
count exact overlaps and return links alone. So a group of thousands of near copies gives no row for
each of its pairs, and no link between components is lost.

What a step keeps for the next ones goes to files by the number of rows, not by the number of shuffle
partitions: on a local file system each file takes processes that the executor's JVM starts to set
its mode, and while one starts, it shares all memory of the JVM and is counted with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracemill.llm import ship, stored
from tracemill.llm import text as X
from tracemill.operators.components import connected_components
from tracemill.session import checkpoint

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
BAND_ROWS = 6
# Of 128 one-bit registers; at the threshold 12.8 differ on average, with a deviation of 3.4.
MOST_BITS = 30
# Two numbers of weighted registers and two of plain ones.
BITS = ("b1", "b2", "p1", "p2")
MERGING_ROUNDS = 1
# Bytes of texts whose shingles are held at once.
TEXT_BYTES = 1 << 20
# Distinct shingles in a chunk of a bucket, on average; 12 bytes each.
BLOCK_SHINGLES = 1_000_000
# Input rows for each file that a step keeps, and for each file of shingle sets or texts.
ROWS_A_FILE = 5_000
TEXTS_A_FILE = 1_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node of each row, row, key, count): the distinct shingles of each row, sorted by row and key.

    A shingle is ``WORDS`` words; a shorter text has one shingle of all its words, a text without
    words none. The node is a key of the row's whole sequence of words.
    """
    n = len(offsets) - 1
    words = X.runs(data, offsets)
    at = X.bounds(words.doc, n)
    size = 1 << max(10, int(len(words.key)).bit_length())
    up, down = X._powers(size)
    total = np.zeros(len(words.key) + 1, dtype=np.uint64)
    np.cumsum(words.key * up[: len(words.key)], out=total[1:])
    length = np.diff(at)
    whole = X.mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + length.astype(np.uint64) * _STEP)
    key, first = X.windows(words.key, words.doc, WORDS)
    short = np.flatnonzero((length > 0) & (length < WORDS))
    row = np.concatenate([words.doc[first], short])
    key = np.concatenate([key, whole[short]])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    return whole.view(np.int64), row[start], key[start], np.diff(np.append(start, len(key)))


def weight(count: np.ndarray) -> np.ndarray:
    """Weight of a shingle that stands ``count`` times in a text."""
    return 1 + np.log(count)


def sketch(row: np.ndarray, key: np.ndarray, w: np.ndarray, n: int, registers: int = BANDS * BAND_ROWS) -> np.ndarray:
    """ProbMinHash registers (n x registers, uint32) of weighted shingles; zeros for rows without any."""
    time = np.full(n * registers, np.inf)
    sign = np.zeros(n * registers, dtype=np.uint32)
    limit = np.full(n, np.inf)
    live = np.arange(len(key))
    now = np.zeros(len(key))
    state = key.copy()
    while len(live):
        state = X.mix(state + _STEP)
        now = now - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[live]
        place = row[live] * registers + (X.mix(state ^ _STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, place, now)
        won = time[place] == now
        sign[place[won]] = (key[live[won]] >> np.uint64(32)).astype(np.uint32)
        rows = np.unique(row[live])
        limit[rows] = time.reshape(n, registers)[rows].max(axis=1)
        on = now < limit[row[live]]  # later arrivals of the others come too late
        live, now, state = live[on], now[on], state[on]
    return sign.reshape(n, registers)


def bands(sign: np.ndarray) -> np.ndarray:
    """One key per band of registers."""
    parts = sign.reshape(len(sign), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = X.mix(key + parts[:, :, j] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j))
    return key.view(np.int64)


def one_bits(sign: np.ndarray) -> np.ndarray:
    """The lowest bit of the first 128 registers, as two 64-bit numbers."""
    return np.packbits((sign[:, :128] & 1).astype(np.uint8), axis=1).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(Jaccard, probability Jaccard) of two texts' sorted shingle keys and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(i)
    plain = len(i) / union if union else 0.0
    if not len(i) or (a[1].max() == 1 and b[1].max() == 1):
        return plain, plain
    p, q = weight(a[1]), weight(b[1])
    p, q = p / p.sum(), q / q.sum()
    x, y = p[i], q[j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # Shingles of one text only lie at either end of the ratios.
    upto = np.searchsorted(ratio, ratio, side="right")
    low = 1 - x.sum() + np.concatenate([[0], np.cumsum(x)])[upto]
    high = 1 - np.concatenate([[0], np.cumsum(y)])[upto]
    return plain, float((x / (low + high / ratio)).sum())


def _similar(a: bytes, b: bytes, threshold: float) -> bool:
    return max(similarity(_parts(a), _parts(b))) >= threshold - 1e-12


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, bands, ``BITS``) of every row; plain bands follow the weighted ones where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch.column(1))
            for lo, hi in X.groups(offsets, TEXT_BYTES):
                node, row, key, count = shingles(data, offsets[lo : hi + 1])
                sign = sketch(row, key, weight(count), hi - lo)
                some = np.bincount(row, minlength=hi - lo) > 0
                again = np.zeros(hi - lo, dtype=bool)
                again[row[count > 1]] = True
                plain, own = sign.copy(), again[row]
                plain[again] = sketch((np.cumsum(again) - 1)[row[own]], key[own], np.ones(own.sum()), int(again.sum()))
                keys = np.concatenate([bands(sign), bands(plain)], axis=1)
                held = np.repeat(np.stack([some, again], axis=1), BANDS, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)), pa.array(keys[held]))
                bits = np.concatenate([one_bits(sign), one_bits(plain)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(node), lists, *(pa.array(bits[:, i]) for i in range(len(BITS)))], [id_col, "node", "bands", *BITS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, node long, bands array<long>, {', '.join(f'{b} long' for b in BITS)}")


def _near(a: str, b: str):
    """Whether few one-bit registers differ, weighted or plain."""
    apart = [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in BITS]
    return (apart[0] + apart[1] <= MOST_BITS) | (apart[2] + apart[3] <= MOST_BITS)


def _files(rows: int, each: int | None = None) -> int:
    return max(1, math.ceil(rows / (each or ROWS_A_FILE)))


def _sets(nodes: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, set): shingle keys and counts of each of ``nodes``; only their texts are read again.

    ``size``, here and below, is the number of rows of ``docs``; no step keeps more nodes.
    """

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_numpy()
            data, offsets = X.utf8(batch.column(1))
            for lo, hi in X.groups(offsets, TEXT_BYTES):
                node, row, key, count = shingles(data, offsets[lo : hi + 1])
                at = X.bounds(row, hi - lo)
                count = count.astype(np.int32)
                own = np.flatnonzero(node == asked[lo:hi])  # an id may have several texts
                yield pa.RecordBatch.from_arrays([
                    pa.array(node[own]),
                    pa.array([key[at[i] : at[i + 1]].tobytes() + count[at[i] : at[i + 1]].tobytes() for i in own], pa.binary()),
                ], ["node", "set"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    named = nodes.join(reps, "node").select("node", F.col("rep").alias("_rep"))
    found = texts.join(named, texts["_id"].eqNullSafe(named["_rep"])).select("node", "_text").mapInArrow(blobs, "node long, set binary")
    return stored(found.dropDuplicates(["node"]).coalesce(_files(size, TEXTS_A_FILE)), "shingle-sets")


def _parts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob[: 8 * n], np.uint64), np.frombuffer(blob[8 * n :], np.int32)


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: float, size: int) -> DataFrame:
    """(u, v, similar) of each pair of nodes, by the exact similarity of their shingles.

    A pair meets the set of ``v``, which stands in few pairs, before that of ``u``, which may stand
    in many. All partitions of the join compare; only their verdicts move to fewer files.
    """
    sets = _sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, reps, id_col, text_col, size)
    right = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
    both = right.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u").select("u", "v", "su", "sv")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [_similar(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), threshold) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_())], ["u", "v", "similar"])

    return checkpoint(both.mapInArrow(compare, "u long, v long, similar boolean").repartition(_files(size)))


class _Forest:
    """Components of a block, joined as links are found."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.root(x)] = self.root(y)


def _block_links(block: pa.Table, threshold: float) -> pa.Table:
    """Links (u, v) of one block: its outer nodes against its inner ones.

    A pair is looked at in the bucket of the least key that its nodes share, so in one block only. Overlaps
    are counted for all candidates of an outer node at once. Components that a link has joined
    within the block are not compared again.
    """
    outer = np.asarray(block["outer"])
    node, part, main = (np.asarray(block[c]) for c in ("node", "part", "main"))
    bits = np.stack([np.asarray(block[c]) for c in BITS], axis=1).view(np.uint64)  # of a negative number the count would be that of its absolute value
    # A column of weighted and one of plain keys for each band.
    keys = np.stack([np.resize(b, 2 * BANDS) for b in block["bands"].to_pylist()]).astype(np.int64).reshape(-1, 2, BANDS)
    here = block["key"][0].as_py()
    sets = [_parts(b) for b in block["set"].to_pylist()]
    share = [w / w.sum() for w in (weight(c) for _, c in sets)]
    flat = np.array([c.max() == 1 for _, c in sets])
    inner = np.flatnonzero(~outer)
    forest, found = _Forest(), []
    for x in np.flatnonzero(outer):
        apart = np.bitwise_count(bits[inner] ^ bits[x]).reshape(-1, 2, 2).sum(axis=2).min(axis=1)
        once = (part[inner] == main[inner]) | (node[x] < node[inner])
        other = inner[(apart <= MOST_BITS) & once & (part[inner] != part[x])]
        theirs = keys[other]
        common = (theirs == keys[x]) | (theirs == keys[x][::-1])
        other = other[np.where(common, theirs, _LAST).min(axis=(1, 2)) == here]
        mine = forest.root(part[x])
        other = other[[forest.root(p) != mine for p in part[other].tolist()]] if len(other) else other
        if not len(other):
            continue
        key = np.concatenate([sets[y][0] for y in other])
        size = np.array([len(sets[y][0]) for y in other])
        start = np.cumsum(size) - size
        own = sets[x][0]
        at = np.minimum(np.searchsorted(own, key), len(own) - 1)
        hit = own[at] == key
        shared = np.add.reduceat(hit.astype(np.int64), start)
        plain = shared / (size + len(own) - shared)
        # The probability Jaccard is at most the sum of the smaller shares of the common shingles.
        most = np.add.reduceat(np.where(hit, np.minimum(share[x][at], np.concatenate([share[y] for y in other])), 0.0), start)
        sure = plain >= threshold - 1e-12
        maybe = ~sure & ~(flat[x] & flat[other]) & (most >= threshold - 1e-9)
        for i in np.concatenate([np.flatnonzero(sure), np.flatnonzero(maybe)]):
            y = other[i]
            if forest.root(part[x]) == forest.root(part[y]):
                continue
            if sure[i] or max(similarity(sets[x], sets[y])) >= threshold - 1e-12:
                forest.join(part[x], part[y])
                found.append((min(node[x], node[y]), max(node[x], node[y])))
    u, v = zip(*found) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _blocks(placed: DataFrame, sets: DataFrame, bands_of: DataFrame, threshold: float) -> DataFrame:
    """Links between the components of each bucket of ``placed`` (key, node, part, main).

    ``bands_of`` has the bands and bits of each node.

    The nodes outside the bucket's main component (outer) meet all of its nodes (inner). Both are
    dealt to chunks of about ``BLOCK_SHINGLES`` shingles, and every pair of chunks is one block, so a
    bucket of any size takes bounded memory and many tasks; rows grow with the chunks, not the pairs.
    """
    full = placed.join(sets.withColumn("n", F.octet_length("set") / 12), "node")
    load = full.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("part") != F.col("main"), F.col("n"))).alias("out"))
    chunks = load.select("key", *[F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int").alias(f"{c}_chunks") for c in ("all", "out")])
    full = full.drop("n").join(bands_of, "node").join(chunks, "key")
    rows = full.select(
        "key", "node", "part", "main", *BITS, "bands", "set",
        F.explode(F.when(F.col("part") != F.col("main"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("outer"),
        F.pmod(F.xxhash64("node"), F.when(F.col("part") != F.col("main"), F.col("out_chunks"))).alias("_o"),
        F.pmod(F.xxhash64("node"), F.col("all_chunks")).alias("_i"), "all_chunks", "out_chunks",
    )
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("outer"), F.col("all_chunks")).otherwise(F.col("out_chunks")) - 1)))
    block = [F.when(F.col("outer"), F.col("_o")).otherwise(F.col("_other")).alias("outer_chunk"), F.when(F.col("outer"), F.col("_other")).otherwise(F.col("_i")).alias("inner_chunk")]
    dealt = dealt.select("key", *block, "outer", "node", "part", "main", *BITS, "bands", "set")
    return dealt.groupBy("key", "outer_chunk", "inner_chunk").applyInArrow(lambda t: _block_links(t, threshold), "u long, v long")


def _roots(parents: DataFrame, size: int) -> DataFrame:
    """(node, part): the root above each node of (node, part), where ``part`` is a smaller node.

    Every node has one parent, so the links are a forest: each round puts a node below its
    parent's parent, and the number of rounds grows with the logarithm of the depth.
    """
    current = checkpoint(parents.coalesce(_files(size)))
    while True:
        above = current.select(F.col("node").alias("part"), F.col("part").alias("_above"))
        moved = current.select("node", "part").join(above, "part", "left")
        moved = moved.select("node", F.coalesce("_above", "part").alias("part"), F.col("_above").isNotNull().alias("_moved"))
        current = checkpoint(moved.coalesce(_files(size)))
        if not current.agg(F.max("_moved")).first()[0]:
            return current.select("node", "part")


def _merged(part: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """``part`` (node, part) after new links (u, v) between nodes; only the parts they join are contracted."""
    ends = links.select("u", "v")
    for end in ("u", "v"):
        at = part.select(F.col("node").alias(end), F.col("part").alias(f"_{end}"))
        ends = ends.join(at, end)
    ends = checkpoint(ends.select(F.col("_u").alias("u"), F.col("_v").alias("v")).filter("u <> v").distinct().coalesce(_files(size)))
    joined = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    found = connected_components(joined, ends, ends.count()).select(F.col("id").alias("part"), F.col("component").alias("_whole"))
    return checkpoint(part.join(found, "part", "left").select("node", F.coalesce("_whole", "part").alias("part")).coalesce(_files(size)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, node, class_id): every row with its class, named by the smallest id of the class.

    Classes are the connected components of links; a link is a similarity of at least ``threshold``
    of the word shingles, weighted (probability Jaccard) or plain. Rows with the same words are
    always of one class, texts without a word, null included, too. Repeated rows stay rows; ``node``
    tells different texts under one id apart. A class without a non-null id has a null name.
    """
    return _classes(docs, id_col, text_col, threshold)[0]


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, int]:
    """Rows of ``near_duplicates`` and their number."""
    ship(docs.sparkSession)
    drawn = stored(sketches(docs, id_col, text_col), "sketches")
    size = drawn.count()

    def kept(df: DataFrame) -> DataFrame:
        return checkpoint(df.coalesce(_files(size)))

    reps = drawn.groupBy("node").agg(F.min(id_col).alias("rep"))
    uniq = kept(drawn.groupBy("node").agg(*(F.first(c).alias(c) for c in ("bands", *BITS))))
    rows = uniq.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").select("key", "lead")
    members = kept(rows.join(buckets, "key"))
    bits = uniq.select("node", *BITS)

    def screened(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose registers may belong to a link."""
        u = bits.select(F.col("node").alias("u"), *(F.col(c).alias(f"u{c}") for c in BITS))
        v = bits.select(F.col("node").alias("v"), *(F.col(c).alias(f"v{c}") for c in BITS))
        return pairs.join(v, "v").join(u, "u").filter(_near("u", "v")).select("u", "v")

    shared = members.filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    leader = shared.groupBy("node").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    first = kept(screened(leader.select(F.col("lead").alias("u"), F.col("node").alias("v"))))
    tested = _verified(first, docs, reps, id_col, text_col, threshold, size)
    roots = _roots(tested.filter("similar").select(F.col("v").alias("node"), F.col("u").alias("part")), size)
    part = kept(uniq.select("node").join(roots, "node", "left").select("node", F.coalesce("part", "node").alias("part")))
    for turn in range(MERGING_ROUNDS + 1):
        # Buckets with several components; the largest of each is its main one.
        placed = members.select("key", "node").join(part, "node")
        each = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64(F.lit(turn), F.col("node"))).alias("one"))
        mixed = each.groupBy("key").agg(F.max_by(F.struct("part", "one"), F.struct("n", "part")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        mixed = mixed.select("key", F.col("m.part").alias("main"), F.col("m.one").alias("centre"))
        if turn < MERGING_ROUNDS:
            pairs = each.join(mixed, "key").filter("part <> main").select(F.least("one", "centre").alias("u"), F.greatest("one", "centre").alias("v"))
            pairs = screened(pairs.distinct())
        else:
            placed = kept(placed.join(mixed, "key"))
            if placed.isEmpty():
                continue
            sets = _sets(placed.select("node").distinct(), docs, reps, id_col, text_col, size)
            links = checkpoint(_blocks(placed, sets, uniq.select("node", "bands", *BITS), threshold).repartition(_files(size)))
            if not links.isEmpty():
                part = _merged(part, links, size)
            continue
        pairs = kept(pairs.join(tested, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            continue
        new = _verified(pairs, docs, reps, id_col, text_col, threshold, size)
        tested = tested.unionByName(new)
        if not new.filter("similar").isEmpty():
            part = _merged(part, new.filter("similar"), size)
    names = kept(reps.join(part, "node").groupBy("part").agg(F.min("rep").alias("class_id")))
    named = kept(part.join(names, "part").select("node", "class_id"))
    return drawn.select(id_col, "node").join(named, "node").coalesce(_files(size)), size


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``near_duplicates``: the one whose id names it. Columns stay as they are.

    Columns may have any name and any type that has a JSON text, maps included. Of rows with one id and
    the same shingles the least by text, then by all columns, stays.
    """
    columns = docs.columns
    # Numbered names, so that no column of ``docs`` meets one of those added here.
    plain = docs.toDF(*[f"_d{i}" for i in range(len(columns))])
    own, body = f"_d{columns.index(id_col)}", f"_d{columns.index(text_col)}"
    classes, size = _classes(plain, own, body, threshold)
    kept = classes.filter(F.col(own).eqNullSafe(F.col("class_id"))).select(F.col(own).alias("_kept"), F.col("node").alias("_kept_node")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(body)
        for batch in batches:
            data, offsets = X.utf8(batch.column(at))
            for lo, hi in X.groups(offsets, TEXT_BYTES):
                node = shingles(data, offsets[lo : hi + 1])[0]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(node)], [*names, "_node"])

    names = plain.columns
    named = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("_node", T.LongType())]))
    found = named.join(kept, named[own].eqNullSafe(kept["_kept"]) & (named["_node"] == kept["_kept_node"]))
    found = found.drop("_kept", "_kept_node")
    again = F.row_number().over(Window.partitionBy(own, "_node").orderBy(body, F.to_json(F.struct(*[F.col(c) for c in names]))))
    return found.withColumn("_again", again).filter("_again = 1").select(*names).toDF(*columns).coalesce(_files(size, TEXTS_A_FILE))
