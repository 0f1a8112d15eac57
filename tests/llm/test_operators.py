"""Each operator against brute force, on the smallest tables and on awkward rows."""

import json
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from tracemill import llm
from tracemill.llm import brown, counts, minhash, mixing, packing, pages, quality, secret_scan, text, toxicity, vptree

llm.load()
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="test tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the word " * 20_000 + "x" * 5_000
AWKWARD = [
    (1, None, "a", 1), (2, "", "a", 0), (3, " \t\n", None, 0), (4, "one", "b", 0), (4, "one", "b", 0), (5, "one", None, 1),
    (6, LONG, "b", 0), (7, LONG, "a", 1), (None, "no id here at all, none", "a", None), (8, "Ünïcödé ﬁ 　 ​ x\x00y", "", 0),
]
SCHEMA = "doc_id long, text string, source string, toxic int, size long, score double, node long, spans string, n_chars long, lang string, key long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those of the results."""
    return spark.createDataFrame([(*r, 5, 0.1, 3, "s", len(r[1] or ""), "en", 9) for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def operators(docs):
    return {
        "quality": quality.measure(docs), "secrets": secret_scan.find_secrets(docs), "redact": secret_scan.redact(docs),
        "counts": counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")),
        "mix": mixing.mix(docs), "near": minhash.near_duplicates(docs),
        "brown": brown.score(docs, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), rate=1e-2, rounds=(1,)),
        "toxicity": toxicity.score(docs, toxicity.fit(docs.select("text", F.col("toxic").alias("label")))),
    }


def test_awkward_rows_keep_their_number(awkward):
    for name, out in operators(awkward).items():
        assert out.count() == len(AWKWARD), name


def test_empty_tables_give_no_rows(awkward, spark):
    none = awkward.filter("false")
    for name, out in operators(none).items():
        assert out.count() == 0, name
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert minhash.deduplicate(none).count() == 0
    assert pages.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert vptree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") >= 0).count() == 0


# --- words


def test_words_and_keys():
    texts = ["", None, " a B\tcc ", "a", "é  a\n", "x" * (text.BLOCK + 9) + " y", "\x0b\x0c", "b"]
    data, offsets = text.utf8(pa.array(texts))
    got = text.runs(data, offsets, lower=True)
    want = [(i, w) for i, t in enumerate(texts) for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()]
    assert got.doc.tolist() == [i for i, _ in want]
    keys = defaultdict(set)
    for (_, w), k in zip(want, got.key.tolist()):
        keys[w].add(k)
    assert all(len(k) == 1 for k in keys.values()) and len({min(k) for k in keys.values()}) == len(keys)


# --- 1 class-based scores


def test_brown_base_score_and_counts(docs, rows):
    out = {r.doc_id: r for r in brown.score(docs, llm.mod_crc("doc_id", 10) == 0).collect()}
    tokens = {i: [w for w in t.encode().lower().split()] + [None] for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in tokens.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_frequent_words_are_counted_in_all_segments(spark):
    """A word at the rate overall that is under it in most segments."""
    texts = ["a " * 12 + "b " * 88] + ["a " * 9 + "b " * 91] * 3 + ["a " * 11 + "c " * 89]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    one = brown.frequent(brown.encode(df, "doc_id", "text", F.lit(False)), 0.1).tolist()
    parts = [brown.encode(df.filter(F.col("doc_id") == i), "doc_id", "text", F.lit(False)) for i in range(5)]
    many = brown.frequent(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]), 0.1).tolist()
    assert len(one) == 3 and many == one


def test_exchange_move_is_the_best_one():
    rng = np.random.default_rng(0)
    n, k = 12, 4
    a = rng.integers(0, 6, (n + 2, n + 2)).astype(float)
    label = np.concatenate([np.arange(n) % k, [k, k + 1]])

    def value(lab):
        p = np.eye(k + 2)[lab]
        g = p.T @ a @ p
        return brown._entropy(g).sum() - brown._entropy(g.sum(1)).sum() - brown._entropy(g.sum(0)).sum()

    p = np.eye(k + 2)[label]
    for w in range(n):
        best = brown.best_move(a[w] @ p, a[:, w] @ p, a[w, w], label[w], p.T @ a @ p, k)
        moved = [value(np.concatenate([label[:w], [c], label[w + 1 :]])) for c in range(k)]
        assert math.isclose(moved[best], max(moved), rel_tol=1e-9)


def test_transitions_are_a_distribution():
    g = np.random.default_rng(1).integers(0, 50, (7, 7)).astype(float)
    assert np.allclose((10 ** brown._log_transitions(g)).sum(1), 1)


# --- 2 toxicity


def test_toxicity_learns_a_word(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(200)]
    made = []
    for i in range(600):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["Vile", "foulness"])
        made.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(made, "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 400"))
    assert 0 < len(model.features) < 500
    scored = toxicity.score(df.filter("doc_id >= 400"), model, keep=("label",)).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.label) for r in scored]) > 0.97


def test_toxicity_without_labels_scores_a_half(awkward):
    model = toxicity.fit(awkward.filter("false").select("text", F.col("toxic").alias("label")))
    assert {r.score for r in toxicity.score(awkward, model).collect()} == {0.5}


# --- 3 packing


def test_packing_is_a_round_trip(awkward, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    special = awkward.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).union(awkward.sparkSession.createDataFrame([(-1, "a<|endoftext|> b  c\n\n d <|endoftext|>")], "doc_id long, text string"))
    out = packing.pack_documents(special, path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts = defaultdict(list)
    for r in special.collect():
        texts[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    for i, lists in texts.items():
        want = Counter(len(x) for x in lists)
        assert sum(r.length for r in pieces[i]) == sum(n * c for n, c in want.items())
        if len(lists) == 1:
            ids = lists[0]
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert sum(r.length for r in out) / (len(sequences) * packing.CAPACITY) > 0.97


def test_long_runs_of_white_space_are_encoded(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing._encoder(path)
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\u3000", "\x1c", "\x85", "a", "don't", "12", "é,", "<|endoftext|>"]
    for n in range(600):
        t = "".join(rng.choices(parts, k=rng.randint(1, 30)))
        assert packing.token_ids(encoder, t, 2 + n % 3).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    n = 2_000_000
    texts = ["a" + " " * n + "b", "a" + "\n" * n, " \n" * (n // 2) + "<|endoftext|> b"]
    for t in texts:
        assert packing.token_ids(encoder, t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    out = packing.pack_documents(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), path)
    assert out.agg(F.sum("length")).first()[0] == len(tokenizer.encode(texts[0], add_special_tokens=False).ids) + 1


def test_differencing_keeps_items_and_capacity():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        windows = packing.pack(sizes, 100)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in w) for w in windows) <= 100
    assert [s for s, _ in packing.difference([8, 7, 6, 5, 4], 2)] == [16, 14]
    assert packing.pack([]) == []


# --- 4 secrets


def test_secrets_base_kinds(spark):
    rng = random.Random(5)
    parts = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4, "é", "\n", "x1", "AKIAAKIA", "0f" * 11, "a-b.c/d", "longvalue9"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def brute(t):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.find_secrets(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "entropy"] == brute(texts[r.doc_id])
    for r in secret_scan.redact(df).collect():
        assert not brute(r.text) or secret_scan.MASK in r.text


def test_entropy_windows_and_allow_list(spark):
    def brute(s, w, bits):
        hit = [i for i in range(len(s) - w + 1) if -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) >= bits - 1e-9]
        return (hit[0], hit[-1] + w) if hit else None

    rng = random.Random(2)
    for _ in range(200):
        s = bytes(rng.choices(b"abcdefgh0123AB", k=rng.randint(1, 60)))
        assert secret_scan.entropy_span(s, 12, 3.0) == brute(s, 12, 3.0)
    key = "q9Zt7Lm2Xc4Vb8Nw1Ks6Df3G"
    texts = [(1, f"é key {key} end"), (2, "Donaudampfschifffahrtsgesellschaft"), (3, f"{key}EXAMPLE"), (4, "123e4567-e89b-12d3-a456-426614174000")]
    out = {r.doc_id: r.spans for r in secret_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in out[1]] == [("entropy", 6, 6 + len(key))]
    assert not out[2] and not out[3] and not out[4]


def test_allow_list_takes_linear_time():
    script = """
import itertools, re
from tracemill.llm.secret_scan import ALLOW
before = re.compile(rb"[A-Za-z]?[a-z]+([_=/+-]+[A-Za-z]?[a-z]+)*[_=/+-]*")
for n in range(1, 7):
    for s in map(bytes, itertools.product(b"aBc-1_", repeat=n)):
        assert bool(before.fullmatch(s)) == bool(re.compile(ALLOW[2]).fullmatch(s)), s
for part in (b"word-", b"WORD-", b"Word_=", b"a/", b"12-", b"deadbeef-"):
    for end in (b"", b"1", b"a1B"):
        [re.compile(p).fullmatch(part * 10_000 + end) for p in ALLOW]
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=60, cwd=Path(__file__).resolve().parents[2])


# --- 5 pages


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<p>a", "a"), ("plain", "plain"), ("<script>no <p>x</p>", ""), ("a < b &amp; c", "a < b & c"),
    ("<body><nav>menu, one, two</nav><article><h1>T</h1><p><b>One,\n two.<br><p>x</article><footer>f</footer>", "T One, two. x"),
    ('<div class="cookie-notice"><p>We use cookies, many, many, many of them</div><div><p>Text that is long enough, it has commas.<p>end</div>', "Text that is long enough, it has commas. end"),
    ('<main><p>Some words, and some more words here.</p><div id="comments"><p>Great post, really, truly, very great</p></div><form>f</form></main>', "Some words, and some more words here."),
])
def test_page_text(spark, html, want):
    got = pages.extract_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert (got.text, got.n_chars) == (want, len(want))


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>t</title><meta charset=utf-8><link rel=x><body><article><h1>T</h1><p>One, two.</p></article></body></html>", "T One, two."),
    ("<head><script>x</script>\n<style>y</style><p>One, two.<br>three", "One, two. three"),
    ("<html><head><title>t</title>One, <b>two</b>", "One, two"),
    ("<head><title>t</title><noscript><p>no</p></noscript><nav>menu</nav><main>One</main>", "One"),
    ("<head><title>t</title></head><body><p>One", "One"),
])
def test_an_open_head_ends_at_the_first_content(html, want):
    assert pages.extract(html) == want


BODY = "Paragraphs that are long enough, with commas, make the text of an article."


@pytest.mark.parametrize("html, want", [
    (f'<body><div class="content has-sidebar"><h1>T</h1><p>{BODY}</p><p>{BODY}</p></div></body>', f"T {BODY} {BODY}"),
    (f'<body><div class="post comments-open"><p>{BODY}</p><p>{BODY}</p></div><div class="ad">Buy this.</div></body>', f"{BODY} {BODY}"),
    (f'<article><p>{BODY}</p><section id="related-work"><p>{BODY}</p></section><p class="notice">Note, {BODY}</p></article>', f"{BODY} {BODY} Note, {BODY}"),
    (f'<main><div class="article-header"><h1>T</h1></div><div class="header"><h1>U</h1></div><p>{BODY}</p></main>', f"T U {BODY}"),
    (f'<body><div class="widget"><p>{BODY}</p><p>{BODY}</p></div><p class="ad">Buy this.</p></body>', f"{BODY} {BODY}"),
    (f'<body><div id="overlay"><article><p>{BODY}</p></article></div></body>', BODY),
    (f'<article><p>{BODY}</p></article><div id="comments"><article><p>{BODY * 9}</p></article></div>', BODY),
    (f'<article><p>{BODY}</p><pre>f()<span class="token comment"># why</span></pre><div class="ad">Buy this.</div></article>', f"{BODY} f()# why"),
])
def test_names_take_out_no_article(html, want):
    assert pages.extract(html) == want


LINKS = '<ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul>'


@pytest.mark.parametrize("html, want", [
    (f"<div class=post><p>Short intro.</p>Loose <b>text</b>, <a>a link</a> in it<div class=text><p>{BODY}<p>{BODY}</div><p>The end.</p></div>", f"Short intro. Loose text, a link in it {BODY} {BODY} The end."),
    (f"<body><div>{LINKS}<div>Intro.</div><div><p>{BODY}<p>{BODY}</div><pre>f()</pre><ul><li>x</ul><section>End.</section></div><div>Imprint</div></body>", f"Intro. {BODY} {BODY} f() x End."),
    (f"<body><div id=a><p>In.</p><div id=b><p>Mid.</p><div id=c><p>{BODY}<p>{BODY}</div></div>Out.</div></body>", f"In. Mid. {BODY} {BODY} Out."),
    (f"<body>{LINKS}<p>First.</p><div><p>{BODY}<p>{BODY}</div><div>Few words</div><p>Last.</p><div>Imprint</div></body>", f"First. {BODY} {BODY} Few words Last."),
    (f"<body><a>Home</a> | <a>About</a><div><p>{BODY}<p>{BODY}</div></body>", f"{BODY} {BODY}"),
    ("<body>x<article><p>One.</p></article><article><p>Two, too.</p></article><main>Three</main></body>", "One. Two, too. Three"),
    (f"<body><article><p>{BODY * 9}</p></article><article><p>Two.</p></article></body>", f"{BODY * 9} Two."),
])
def test_text_beside_the_best_container_is_kept(html, want):
    assert pages.extract(html) == want


def test_pages_hold_their_article(spark):
    from html import unescape

    table = spark.read.parquet(f"{D}/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract_text(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())


# --- 6 quality


def test_quality_equals_sql(spark):
    assert difference(llm.QUERIES["op6_quality"](spark, D), connect(D), llm.SQL["op6_quality"]) is None


def test_ablations(docs):
    entries = quality.ledger(quality.measure(docs)).cache()
    all_ = [r.failures for r in entries.select("failures").collect()]
    m = quality.mask(quality.POLICIES["v2"])
    bit = {n: 1 << b for b, n, _ in quality.RULES}
    for r in quality.ablations(entries, "v2").collect():
        b = bit[r.rule]
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(x & b > 0 for x in all_), sum(x & m == b for x in all_), sum(x & m & ~b == 0 for x in all_))


# --- 7 mixing


def test_fit_reaches_the_nearest_sum():
    rng = random.Random(4)
    for _ in range(200):
        sizes = Counter(rng.choice([3, 5, 8, 13, 21]) for _ in range(rng.randint(1, 12)))
        budget = rng.randint(0, sum(s * c for s, c in sizes.items()))
        take = mixing.fit(dict(sizes), budget)
        assert all(0 <= take.get(s, 0) <= c for s, c in sizes.items())
        got = sum(s * k for s, k in take.items())
        low = {s: c * budget // sum(x * y for x, y in sizes.items()) for s, c in sizes.items()}
        reach = {sum(s * k for s, k in low.items())}
        for s, c in sizes.items():
            reach = {r + s * j for r in reach for j in range(c - low[s] + 1)}
        assert got == max(r for r in reach if r <= budget)


def test_mixture_targets(docs, rows):
    out = mixing.mix(docs, keep=("source",)).collect()
    size = Counter()
    for r in out:
        size[r.source] += r.size
    assert {r.doc_id: r.size for r in out} == {i: len(WORD.findall(t)) for i, t in rows}
    target = dict(zip(sorted(size), mixing.fill_targets([size[s] for s in sorted(size)], [(5, 2, 1)[i % 3] for i in range(len(size))], 1.5 * sum(size.values()))))
    taken = Counter()
    for r in out:
        assert math.isclose(r.target, target[r.source]) and r.source_size == size[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    longest = max(r.size for r in out)
    assert all(target[s] - longest <= taken[s] <= target[s] + 1 for s in size)
    again = mixing.mix(docs.repartition(5)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in out}


def test_targets_stop_at_the_cap():
    assert mixing.fill_targets([10, 10, 100], [5.0, 2.0, 1.0], 180.0) == [20.0, 20.0, 140.0]
    assert mixing.fill_targets([0, 0], [1.0, 1.0], 0.0) == [0.0, 0.0]


# --- 8 token counts


def test_token_counts_equal_the_library(awkward, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = counts.token_counts(awkward, public_tokenizers.path("piece_bpe_32k.model"), chunk=2048).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == Counter(
        (i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in AWKWARD
    )
    rng = random.Random(3)
    pieces = ["a", "  ", "b", " the", "\n", " ", "éa", "x" * 40, "▁", "　", "</s>", "ﬁ"]
    for _ in range(100):
        t = "".join(rng.choices(pieces, k=rng.randint(1, 300)))
        assert counts.spliced_count(model, t, 32, 4) == len(model.encode(t))
    for _, t in rows[:40]:
        assert counts.spliced_count(model, t, 200, 16) == len(model.encode(t))


# --- 9 nearest vectors


def brute_nearest(ids, x, k):
    out = {}
    for q, v in zip(ids, x):
        if q % 20 == 0:
            scored = sorted((-float(v @ w), i) for i, w in zip(ids, x) if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (700, 6)).astype(float)  # many ties
    x[100:400] = x[100]  # a third of all rows alike
    x = x[np.abs(x).sum(1) > 0]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, id int")
    bad = spark.createDataFrame([(10_000, None, 1), (10_020, [0.0] * 6, 1), (10_040, [float("nan")] * 6, 1), (10_060, [1.0, None] * 3, 1)], df.schema)
    got = defaultdict(list)
    for r in vptree.nearest(df.unionByName(bad).unionByName(df.limit(0)), F.col("id") % 20 == 0, relax=1.0, shard=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    assert got == brute_nearest(list(range(len(x))), x, 20)


def test_recall_of_the_query(spark):
    table = spark.read.parquet(f"{D}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute_nearest([r.vec_id for r in table], np.array([r.embedding for r in table], dtype=float), 20)
    got = defaultdict(set)
    for r in llm.QUERIES["op9_vptree"](spark, D).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9


# --- 10 near duplicates


def sets_of(texts):
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    a = np.arange(300, dtype=np.uint64)
    wa, wb = rng.integers(1, 5, 300), rng.integers(1, 5, 300)
    wb[:60] = 0
    ka, kb = text.mix(a + np.uint64(1)), text.mix(a + np.uint64(1))[60:]
    row = np.concatenate([np.zeros(300, int), np.ones(240, int)])
    key, w = np.concatenate([ka, kb]), np.concatenate([minhash.weight(wa), minhash.weight(wb[60:])])
    s = minhash.sketch(row, key, w, 2, registers=4096)
    oa, ob = np.argsort(ka), np.argsort(kb)
    _, exact = minhash.similarity((ka[oa], wa[oa]), (kb[ob], wb[60:][ob]))
    p, q = np.zeros(300), np.zeros(300)
    p[:], q[60:] = minhash.weight(wa), minhash.weight(wb[60:])
    p, q = p / p.sum(), q / q.sum()
    brute = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in range(60, 300))
    assert math.isclose(exact, brute, rel_tol=1e-9)
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


@pytest.mark.parametrize("merging, chunk", [(minhash.MERGING_ROUNDS, minhash.BLOCK_SHINGLES), (0, 500)])
def test_classes_equal_brute_force(spark, rows, monkeypatch, merging, chunk):
    """Also with all work left to blocks, of a few texts each."""
    monkeypatch.setattr(minhash, "MERGING_ROUNDS", merging)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", chunk)
    rng = random.Random(8)
    texts = [t for _, t in rows]
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for n in range(150):  # a group of near copies, some too far
        copy = list(base)
        for j in rng.sample(range(120), rng.randint(0, 6)):
            copy[j] = f"e{n}-{j}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 40 + ["", None, "one two", "one two", "one three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    sets = sets_of(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = sets[i] == sets[j] if not sets[i] or not sets[j] else len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if same and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(texts))}
    assert sum(got[i] != want[i] for i in want) <= 2  # weighted similarity may add a link at the border
    assert all(got[i] == got[want[i]] for i in want)  # and none is lost
    kept = minhash.deduplicate(df.withColumn("_kept", F.lit(1))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))


@pytest.mark.parametrize("merging", [minhash.MERGING_ROUNDS, 0])
def test_repeated_passages_do_not_hide_a_plain_link(spark, monkeypatch, merging):
    """The same shingles, up to four, in very different numbers."""
    monkeypatch.setattr(minhash, "MERGING_ROUNDS", merging)
    rng = random.Random(9)
    texts = []
    for n in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        often = (50, 100, 60, 20)[n % 4]
        texts += [" ".join(words), " ".join(words + words[204 - often :] * (20, 400, 200, 300)[n % 4])]
    sets = sets_of(texts)
    assert all(len(a & b) >= 0.9 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}
    assert sorted(r.doc_id for r in minhash.deduplicate(df).select("doc_id").collect()) == list(range(0, len(texts), 2))


# --- pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as pipeline

    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, D).cache()
        assert out.columns == docs.columns, name
        before = {r.doc_id: r for r in kept.collect()}
        now = out.collect()
        if name == "near_duplicates":
            classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(kept).collect()}
            assert sorted(r.doc_id for r in now) == sorted(set(classes.values()))
        elif name == "secrets":
            assert len(now) == len(before) and all(r.n_chars == len(r.text) for r in now)
            assert all(not any(s.kind != "entropy" for s in r.spans) for r in secret_scan.find_secrets(out).collect())
        elif name == "mixing":
            want = {r.doc_id: r.times for r in mixing.mix(kept).collect()}
            assert Counter(r.doc_id for r in now) == Counter({i: n for i, n in want.items() if n})
        kept = out
    packed = pipeline.STAGES[-1][1](spark, kept, D)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
    assert packed.filter("start = 0").count() == kept.count()
    assert json.dumps([n for n, _ in pipeline.STAGES])
