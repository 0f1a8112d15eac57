"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tracemill.llm import alignment, bpe, brown, counts, minhash, mixing, mod_crc, packing, pages, periodic, quality, query, secret_scan, table, toxicity, vptree


@query("op2_toxicity")
def op2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = toxicity.sample(docs, table(spark, d, "labels"), mod_crc("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(rows))
    return scored.select(
        "doc_id", (mod_crc("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op3_packing")
def op3(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_secrets")
def op4(spark, d):
    found = secret_scan.find_secrets(table(spark, d, "documents"))

    def n(kind):
        return F.size(secret_scan.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}")

    base = secret_scan.digest(secret_scan.of_kind(F.col("spans"), "assign", "access", "hex"))
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), n("entropy"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.digest(F.col("spans")).alias("spans"),
    )


@query("op5_html")
def op5(spark, d):
    return pages.extract_text(table(spark, d, "pages"))


OP6 = """with docs as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
words as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from docs),
pos as (select r, unnest(range(1, len(w) - 1)) i, w from words where len(w) >= 3),
win as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) c from pos),
rep as (select r, count(distinct i + j) n_repeat_words from (select r, i, unnest([0, 1, 2]) j from win where c > 1) group by 1),
dup as (select r, sum(c - 1) n_dup_lines from (select r, x, count(*) c from (select r, unnest(l) x from words) group by 1, 2) group by 1),
m as (select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint n_repeat_words, len(l) n_lines, length(regexp_replace(t, '[^0-9]', '', 'g')) n_digits,
  coalesce(list_max(list_transform(w, lambda x: length(x))), 0) n_longest_word
  from words left join rep using (r) left join dup using (r)),
f as (select *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 40 * n_words, 100 * n_dup_lines > 50 * n_lines,
  word_chars > 25 * n_words, 2 * word_chars < 3 * n_words, 100 * n_digits > 30 * word_chars, n_words = 0, n_longest_word > 1000] fails,
  ['few_words', 'repeated_words', 'symbols', 'duplicate_lines', 'long_words', 'short_words', 'digits', 'no_words', 'giant_word'] names from m)
select doc_id, n_lines::bigint n_lines, n_digits::bigint n_digits, n_longest_word::bigint n_longest_word,
  list_sum(list_transform(range(9), lambda i: case when fails[i + 1] then 1 << i else 0 end))::bigint failures,
  not list_contains(fails, true) kept_v3,
  case when len(list_filter(fails, lambda x: x)) = 1 then names[list_position(fails, true)] end sole_failure, n_words::bigint n_words, word_chars, n_symbols::bigint n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 40 * n_words
    or 100 * n_dup_lines > 50 * n_lines or word_chars > 25 * n_words or 2 * word_chars < 3 * n_words
    or 100 * n_digits > 30 * word_chars) kept from f"""


@query("op6_quality", OP6)
def op6(spark, d):
    entries = quality.ledger(quality.measure(table(spark, d, "documents")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_digits", "n_longest_word", "failures", (~quality.passes("v1")).alias("base_failed"), quality.passes("v2").alias("kept"),
        quality.passes("v3").alias("kept_v3"), quality.sole_failure("v3").alias("sole_failure"),
    )


@query("op7_mixing")
def op7(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_counts")
def op8(spark, d):
    return counts.token_counts(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_vptree")
def op9(spark, d):
    found = vptree.nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op1_brown")
def op1(spark, d):
    return brown.score(table(spark, d, "documents"), mod_crc("doc_id", 10) == 0)


@query("op10_probminhash")
def op10(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents")).select("doc_id", "class_id")


OP11 = """with recursive bits(b, c, i) as (
  select range, range, 0 from range(256)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from bits where i < 8),
crc_table as (select b, c from bits where i = 8),
docs as (select row_number() over () r, doc_id, coalesce(doc_id::varchar, '') s, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
crc(r, s, i, c) as (
  select r, s, 1, 4294967295 from docs
  union all select r, s, i + 1, xor(crc.c >> 8, t.c) from crc join crc_table t on t.b = xor(crc.c, ord(s[i])) & 255 where i <= length(s)),
h as (select r, xor(c, 4294967295) h, xor(c, 4294967295) // 10 g from crc where i = length(s) + 1),
plan as (select docs.r, doc_id, w, len(w) n, h % 10 = 0 and len(w) > 0 planted, case when len(w) > 0 then g % len(w) end a, g from docs join h using (r)),
words as (select r, doc_id, n, case when planted
  then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end w from plan),
pos as (select r, n, unnest(w) x, unnest(range(n)) i from words),
same as (select p.r, q.i - p.i as lag, p.i from pos p join pos q on p.r = q.r and p.x = q.x and q.i > p.i and 4 * (q.i - p.i) <= p.n),
islands as (select r, lag, min(i) start, count(*) + lag as length
  from (select *, i - row_number() over (partition by r, lag order by i) g from same) group by r, lag, g having count(*) + lag >= greatest(6, 4 * lag)),
runs as (select r, start, length, min(lag) period from islands group by all),
best as (select r, count(*) n_runs, arg_min({'start': start, 'length': length, 'period': period}, {'l': -length, 's': start, 'p': period}) b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) lines from runs group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) i from runs),
kept as (select r, string_agg(x, ' ' order by i) t from pos anti join gone using (r, i) group by r)
select doc_id, coalesce(n_runs, 0)::bigint n_runs, b.start::bigint "start", b.length::bigint "length", b.period::bigint period,
  (1000 * b.length // b.period)::bigint exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
from words left join best using (r) left join kept using (r)"""


def planted(docs):
    """Texts as the periodic-run query has them: a tenth of the ids repeat a part of their words to the end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", h.alias("_h")).select("doc_id", "text", F.expr("_h div 10").alias("_g"), words.alias("_w"))
    cut = cut.withColumn("_a", F.when(F.size("_w") > 0, F.col("_g") % F.size("_w")))
    cut = cut.withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)"))
    told = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[cast(_a + (i - _a) % _p as int)])), ' ')")
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), told).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", OP11)
def op11(spark, d):
    found = periodic.periodic_runs(planted(table(spark, d, "documents")))
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    longest = F.expr("array_min(transform(runs, x -> struct(-x.length as l, x.start as start, x.period as period)))")
    return found.withColumn("_b", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), (-F.col("_b.l")).alias("length"),
        F.col("_b.period").alias("period"), F.expr("(-1000 * _b.l) div _b.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_rank_queue_bpe")
def op12(spark, d):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, d, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op13_token_alignment")
def op13(spark, d):
    found = alignment.align(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
