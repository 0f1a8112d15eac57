"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document. Versioned policies and ablations then read the stored
bits only: no text is scanned again when a policy changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import ship
from tracemill.llm import text as X

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_digits long, n_longest_word long"
SYMBOLS = b"#*$%&|<>"


def _measure_rows(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    body = data[offsets[0] : offsets[-1]]
    words = X.runs(data, offsets)
    n_words = np.bincount(words.doc, minlength=n)
    lead = np.zeros(len(body) + 1, dtype=np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=lead[1:])
    at = int(offsets[0])
    chars = lead[words.end - at] - lead[words.start - at]
    word_chars = np.bincount(words.doc, weights=chars, minlength=n).astype(np.int64)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, words.doc, chars)
    symbols = np.zeros(256, dtype=bool)
    symbols[list(SYMBOLS)] = True
    digits = np.zeros(256, dtype=bool)
    digits[48:58] = True

    lines = X.runs(data, offsets, separators=b"\n")
    first_word = np.searchsorted(words.start, lines.start)
    full = np.zeros(len(lines.key), dtype=bool)
    some = first_word < len(words.start)
    full[some] = words.start[first_word[some]] < lines.end[some]
    doc, key = lines.doc[full], lines.key[full]
    n_lines = np.bincount(doc, minlength=n)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    again = np.zeros(len(doc), dtype=bool)
    again[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])
    dup_lines = np.bincount(doc[again], minlength=n)

    key, first = X.windows(words.key, words.doc, 3)
    owner = words.doc[first]
    order = np.lexsort((key, owner))
    k, o = key[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(k), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words.key), dtype=bool)
    for j in range(3):
        covered[first[order[twice]] + j] = True
    repeats = np.bincount(words.doc[covered], minlength=n)
    return [n_words, word_chars, X.row_sums(symbols[body], offsets), dup_lines, repeats, n_lines, X.row_sums(digits[body], offsets), longest]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements of ``MEASURES``) of every whole text.

    A null or empty text measures 0 everywhere. Rows are independent: repeated ids give repeated
    rows, an empty table gives no rows, other columns are not read.
    """
    ship(docs.sparkSession)
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch.column(1))
            for lo, hi in X.groups(offsets):
                cols = _measure_rows(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in cols)], [id_col, *names]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {MEASURES}")


# Bit number, name, condition under which a document fails. Bits are never reused: a changed
# threshold is a new rule, so that stored ledgers keep their meaning.
RULES: list[tuple[int, str, str]] = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 40 * n_words"),
    (3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    (4, "long_words", "word_chars > 25 * n_words"),
    (5, "short_words", "2 * word_chars < 3 * n_words"),
    (6, "digits", "100 * n_digits > 30 * word_chars"),
    (7, "no_words", "n_words = 0"),
    (8, "giant_word", "n_longest_word > 1000"),
]
BASE = ("few_words", "repeated_words")
# Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines", "long_words", "short_words", "digits", "no_words"),
    "v3": (*BASE, "symbols", "duplicate_lines", "long_words", "short_words", "digits", "no_words", "giant_word"),
}


def mask(rules: tuple[str, ...]) -> int:
    bit = {name: b for b, name, _ in RULES}
    return sum(1 << bit[r] for r in rules)


def ledger(measured: DataFrame) -> DataFrame:
    """Add ``failures``: one bit for each rule that the row fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, cond in RULES]
    return measured.withColumn("failures", reduce(Column.bitwiseOR, bits).cast("long"))


def passes(policy: str) -> Column:
    """Whether a ledger row fails no rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def sole_failure(policy: str) -> Column:
    """The rule of the policy without which a ledger row would pass, null where none or several reject."""
    failed = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    return F.coalesce(*[F.when(failed == 1 << b, F.lit(n)) for b, n, _ in RULES if n in POLICIES[policy]])


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, failed_alone, kept_without) of each rule of a policy, from the bits alone.

    ``failed_alone`` counts the rows that only this rule rejects, ``kept_without`` the rows that
    the policy keeps without it. One row per failure pattern is grouped first, so any number of
    rows takes one pass and patterns, of which there are few, carry the rest.
    """
    m = F.lit(mask(POLICIES[policy])).cast("long")
    patterns = entries.groupBy(F.col("failures").bitwiseAND(m).alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, n, _ in RULES if n in POLICIES[policy]])
    each = patterns.select("_bits", "_n", F.explode(rules).alias("r"))
    rest = F.col("_bits").bitwiseAND(F.bitwiseNOT(F.col("r.bit")))
    hit = F.col("_bits").bitwiseAND(F.col("r.bit")) != 0

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)).cast("long")

    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(hit).alias("failed"), total(hit & (rest == 0)).alias("failed_alone"), total(rest == 0).alias("kept_without")
    )
