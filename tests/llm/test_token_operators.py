"""Periodic runs, rank-queue BPE and token alignment against brute force and the named libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from oracle import connect, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill import llm
from tracemill.llm import alignment, bpe, periodic, queries

llm.load()
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="test tables not present")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "ab cd " * 9000 + "x" * 30_000
AWKWARD = [
    (1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "a a a a a a", 4), (4, "a a a a a a", 4), (5, LONG, 5), (None, "no id <|endoftext|> <s>", 6),
    (6, "Ünïcödé ﬁ 　 ​ x\x00y \x1c\x85 日本語 \U0001f600", 7), (7, "one  two   three\n\nfour ", 8),
]
SCHEMA = "doc_id long, text string, n_tokens long, ids string, runs int, segment int, pair string, a int, groups long, `x.y` int, m map<string,int>"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those of the results."""
    return spark.createDataFrame([(i, t, n, "i", 1, 2, "p", 3, 4, 5, {"k": 1}) for i, t, n in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def run_all(docs):
    encoded = bpe.encode(docs, MULTI, public_tokenizers.PATTERN)
    return {"runs": periodic.periodic_runs(docs), "encode": encoded, "decode": bpe.decode(encoded, MULTI), "align": alignment.align(docs, BYTE, PIECE)}


def test_awkward_rows_keep_their_number(awkward):
    for name, out in run_all(awkward).items():
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert ids == Counter(i for i, _, _ in AWKWARD), name


def test_empty_tables_give_no_rows(awkward):
    for name, out in run_all(awkward.filter("false")).items():
        assert out.count() == 0, name


# --- periodic runs


def brute_runs(x):
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(x[k] == x[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def periodic_words(rng):
    letters, size, x = rng.choice([1, 2, 3, 50]), rng.choice([20, 100, 400]), []
    while len(x) < size:
        if rng.random() < 0.5:
            x += [rng.randrange(letters) for _ in range(rng.randrange(12))]
        else:
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, rng.choice([4, 12, 40])))]
            x += (part * 8)[: int(len(part) * rng.uniform(1, 7))]
    return x


@pytest.mark.parametrize("direct", [1, 2, 4, 8])
def test_runs_equal_brute_force(direct):
    rng = random.Random(direct)
    found = 0
    for _ in range(300):
        x = periodic_words(rng)
        want = brute_runs(x)
        assert [tuple(r) for r in periodic.find_runs(np.array(x), len(x), direct).tolist()] == want
        found += len(want)
    assert found > 200


def test_runs_of_fibonacci_words_and_of_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.find_runs(np.array(b), len(b)).tolist()] == brute_runs(b)
    part = np.random.RandomState(1).randint(0, 9, 5000)
    x = np.concatenate([[10, 11], np.tile(part, 4), part[:7], [12]])
    assert periodic.find_runs(x, len(x)).tolist() == [[2, 20007, 5000]]
    assert periodic.find_runs(x[:-9], len(x) - 9).tolist() == []  # one word short of four periods


def test_minimizers_equal_brute_force():
    rng = np.random.RandomState(2)
    for w in (1, 2, 8):
        key = rng.randint(0, 30, 100).astype(np.uint64)
        want = {i + j for i in range(len(key) - w + 1) for j in range(w) if key[i + j] == key[i : i + w].min()}
        assert set(periodic.minimizers(key, w).tolist()) == want
    assert len(periodic.minimizers(key[:3], 8)) == 0


def test_texts_of_a_batch_do_not_meet(spark):
    rows = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame([(i, "a b " * i) for i in range(8)], "doc_id long, text string").coalesce(1)).collect()}
    assert [len(rows[i].runs) for i in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert tuple(rows[5].runs[0]) == (0, 10, 2) and rows[5].collapsed == "a b" and rows[3].collapsed == "a b a b a b"


def test_overlapping_runs_drop_the_union(spark):
    words = "x a a a a a a b a a a a a a b a a a a a a b a a a a a a b y".split()
    row = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    want = brute_runs(words)
    gone = {i for s, n, q in want for i in range(s + q, s + n)}
    assert [tuple(r) for r in row.runs] == want and len(want) > 1
    assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_query_on_awkward_rows_and_its_sql(spark, awkward, tmp_path):
    awkward.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/d")
    (next(Path(tmp_path, "d").glob("*.parquet"))).rename(tmp_path / "documents.parquet")
    got = queries.op11(spark, str(tmp_path))
    small = connect(str(tmp_path))
    assert difference(got, small, queries.OP11) is None
    for r in queries.planted(awkward).collect():
        text = next(t for i, t, _ in AWKWARD if i == r.doc_id)
        h = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        assert r.text == text or h % 10 == 0


def test_runs_query_equals_sql(spark):
    assert difference(queries.op11(spark, D), connect(D), queries.OP11) is None


# --- rank-queue BPE


@pytest.fixture(scope="module")
def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["ab", "abc ", "aeiou tns", "éa日本 x", " \n\ta", "0123 ", "'sn't "])
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(120)))


def test_ids_equal_the_library_on_random_texts(multi):
    encoder = bpe.load_encoder(MULTI, public_tokenizers.PATTERN, bpe.odd_characters())
    texts = [*pieces(800, 5), "a" * 100_001, "ab" * 50_000, "".join(random.Random(1).choices("abcdefgh", k=100_000)), " " * 2_000_000 + "x"]
    got = encoder.encode(texts)
    for t, ids in zip(texts[:-1], got):
        assert ids.tolist() == multi.encode_ordinary(t)
    assert got[-1].tolist()[-1] == bpe.load_ranks(MULTI)[b" x"]


def test_every_code_point_splits_as_the_library_does(multi):
    encoder = bpe.load_encoder(MULTI, public_tokenizers.PATTERN, bpe.odd_characters())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{}", "a{}b", " {}1", "'{}s"):
        texts = ["".join(form.format(c) for c in every[i : i + 20_000]) for i in range(0, len(every), 20_000)]
        for t, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == multi.encode_ordinary(t)


@pytest.mark.parametrize("many", [1, 3, 10**9])
def test_any_ranks_give_the_ids_of_the_library(many):
    """Ranks in random order, so that merges make pairs of lower ranks."""
    rng = random.Random(many)
    for _ in range(40):
        tokens = {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(60)}
        order = rng.sample(sorted(tokens), len(tokens))
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        library = tiktoken.Encoding("random", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choices("abc", k=rng.randrange(1, 90))) for _ in range(20)]
        ids, count = bpe.Vocabulary(ranks).merge([t.encode() for t in texts], many=many)
        want = [library.encode_ordinary(t) for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and count.tolist() == list(map(len, want))


def test_a_full_cache_is_begun_anew(monkeypatch, multi):
    monkeypatch.setattr(bpe, "CACHED", 50)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.load_ranks(MULTI)), public_tokenizers.PATTERN, bpe.odd_characters())
    for t in pieces(200, 9):
        assert encoder.encode([t])[0].tolist() == multi.encode_ordinary(t)


def test_groups_of_a_batch_cover_it(monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 10)
    batch = pa.record_batch([pa.array(range(6)), pa.array(["x" * 30, None, "abc", "", "defghijk", "l"])], ["i", "t"])
    parts = list(bpe._groups(batch, 1))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2, 3], [4, 5]] or sum((p.column(0).to_pylist() for p in parts), []) == list(range(6))


def test_bpe_query_round_trip(spark, docs, multi):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op12(spark, D).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = multi.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_vocabulary_without_single_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0, b"b": 1, b"ab": 2})


# --- alignment


def brute_alignment(rows):
    """Rows as the query gives them, token by token and byte by byte, from the named libraries."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    level = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for c in range(256):
        if c not in level.values():
            level[chr(256 + sum(1 for v in level if ord(v) > 255))] = c
    docs, held = [], defaultdict(set)
    for n, (i, t) in enumerate(rows):
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, list(b.encode(t or ""))
        bx = [bytes(level[c] for c in a.id_to_token(k)) for k in x]
        by = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not t or b"".join(bx) != b" " + t.encode() or b"".join(by) != b" " + t.encode():
            x, y, bx, by = [], [], [], []
        ea, eb = np.cumsum([len(p) for p in bx]).tolist(), np.cumsum([len(p) for p in by]).tolist()
        links = [(p, q) for p in range(len(x)) for q in range(len(y)) if max(ea[p] - len(bx[p]), eb[q] - len(by[q])) < min(ea[p], eb[q])] if len(x) < 400 else None
        if links is None:  # by bytes
            own = lambda e, p: [k for k, z in enumerate(p) for _ in z]
            links = sorted(set(zip(own(ea, bx), own(eb, by))))
        cuts, parts, p, q = set(ea) & set(eb), [], 0, 0
        for c in sorted(cuts):
            r, s = ea.index(c) + 1 if len(x) < 400 else int(np.searchsorted(ea, c)) + 1, int(np.searchsorted(eb, c)) + 1
            parts.append(",".join(map(str, x[p:r])) + "|" + ",".join(map(str, y[q:s])))
            p, q = r, s
        docs.append((i, x, y, links, ";".join(parts), len(cuts)))
        for p, q in links:
            held[x[p], y[q]].add(n)
    best = defaultdict(int)
    for (p, _), who in held.items():
        best[p] = max(best[p], len(who))
    out = []
    for i, x, y, links, parts, n_groups in docs:
        n = [len(held[x[p], y[q]]) for p, q in links]
        digest = hashlib.sha256(parts.encode()).hexdigest() if x else ""
        out.append((i, len(x), len(y), n_groups, len(links), sum(c == best[x[p]] for c, (p, _) in zip(n, links)), sum(n), digest))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_equals_brute_force(spark, docs):
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((tuple(r[c] for c in ALIGNED) for r in queries.op13(spark, D).collect()), key=repr)
    assert got == want


def test_alignment_of_awkward_rows_in_small_segments(awkward):
    want = brute_alignment([(i, t) for i, t, _ in AWKWARD])
    for segment in (1, 40, alignment.SEGMENT):
        found = alignment.align(awkward, BYTE, PIECE, segment=segment)
        digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
        got = sorted((tuple(r) for r in found.select(*ALIGNED[:-1], digest).collect()), key=repr)
        assert got == want


def test_coalescing_of_random_intervals():
    rng = np.random.RandomState(4)
    for _ in range(300):
        cuts = [np.sort(np.append(rng.choice(np.arange(1, 40), rng.randint(0, 20), replace=False), 40)) for _ in range(2)]
        a, b = (np.diff(c, prepend=0) for c in cuts)
        links = alignment.coalesce(a, b)
        common = sorted(set(cuts[0].tolist()) & set(cuts[1].tolist()))
        assert links.a_group.tolist() == np.searchsorted(common, cuts[0]).tolist()
        assert links.b_group.tolist() == np.searchsorted(common, cuts[1]).tolist()
        want = [(p, q) for p in range(len(a)) for q in range(len(b)) if max(cuts[0][p] - a[p], cuts[1][q] - b[q]) < min(cuts[0][p], cuts[1][q])]
        assert list(zip(links.a.tolist(), links.b.tolist())) == want
