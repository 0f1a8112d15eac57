"""Atomic actions from raw text: one row per action (P20).

The reference output comes from a language model and cannot be reproduced; this keeps
its contract (action, acteur, timestamp, contexte_supp) with fixed rules: a text is cut
into lines and sentences, a leading time and a leading 'name:' are taken off, and
greetings and empty pieces are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import non_blank, strip

# Fixed values.
GREETINGS = [
    "bonjour", "bonsoir", "salut", "coucou", "merci", "hello", "hi", "hey", "thanks",
    "thank you", "hola", "gracias", "hallo", "danke", "ok", "okay",
]
_TIME = r"^\[?(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)\]?"
_ACTOR = r"^([\p{L}][\p{L}\p{N} ._-]{0,40}?)\s*:\s+"
_PIECES = r"(?:\r?\n)+|(?<=[.!?])\s+"


def _greeting(text: Column) -> Column:
    return F.lower(text).rlike(r"^(?:" + "|".join(GREETINGS) + r")\b[\s,.!?]*$")


def atomic_actions(
    df: DataFrame, text: str = "text", actor: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """P20: (kept columns, action_no, action, acteur, timestamp, contexte_supp).

    ``actor`` names a column used where the line states nobody. ``contexte_supp`` is the
    text in brackets at the end of a line, if any.
    """
    fallback = F.col(actor) if actor else F.lit(None).cast("string")
    keep = keep or []
    pieces = df.select(
        *keep, fallback.alias("_fallback"), F.posexplode(F.split(text, _PIECES)).alias("action_no", "_line")
    ).withColumn("_line", strip("_line"))
    stamped = pieces.withColumn("_at", F.regexp_extract("_line", _TIME, 1)).withColumn(
        "_rest", strip(F.regexp_replace("_line", _TIME, ""))
    )
    spoken = stamped.withColumn("_who", F.regexp_extract("_rest", _ACTOR, 1)).withColumn(
        "_body", strip(F.regexp_replace("_rest", _ACTOR, ""))
    )
    context = F.regexp_extract("_body", r"[\[(]([^\[\]()]+)[\])]\s*[.!?]?$", 1)
    return spoken.filter(non_blank("_body") & ~_greeting(F.col("_body"))).select(
        *keep,
        "action_no",
        F.col("_body").alias("action"),
        F.coalesce(F.nullif(F.col("_who"), F.lit("")), F.col("_fallback")).alias("acteur"),
        F.try_to_timestamp(F.nullif(F.col("_at"), F.lit(""))).alias("timestamp"),
        F.nullif(context, F.lit("")).alias("contexte_supp"),
    )
