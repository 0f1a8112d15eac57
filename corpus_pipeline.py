"""From raw documents to packed sequences: five stages, each on what the one before it kept.

All stages but the last return the columns of their input. ``ORACLE_SQL`` is None, as no stage but
the mixture's arithmetic can be put in SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pathlib import Path
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracemill.llm import minhash, mixing, mod_crc, packing, secret_scan, stored, table, toxicity  # noqa: E402


def _numbered(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with numbers for column names but ``names``, so that no name meets one that a stage adds."""
    return docs.toDF(*[c if c in names else f"_d{i}" for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; labels of a fifth of the ids are not learned from.

    Null and empty texts score the model's bias. Without labels nothing is rejected.
    """
    rows = toxicity.sample(docs, table(spark, sf_dir, "labels"), mod_crc("doc_id", 5) != 0)
    model = toxicity.fit(rows)
    if not len(model.features):
        return docs
    plain = _numbered(docs, "doc_id", "text")
    scored = toxicity.score(plain, model, keep=tuple(plain.columns))
    return scored.filter("score < 0.5").select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return minhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets masked; ``n_chars`` follows the text."""
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice."""
    plain = _numbered(docs, "doc_id", "text", "source")
    mixed = mixing.mix(plain, keep=tuple(c for c in plain.columns if c != "doc_id"))
    repeated = mixed.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return repeated.select(*plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
