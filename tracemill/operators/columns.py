"""Column search by candidate name (schema only, no job)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate names in order of preference.
# Normaliser, exact spelling.
TEXT_NAMES = ["content", "action", "etape", "category", "description", "titre", "nom", "label"]
DURATION_NAMES = [
    "duration_minutes", "duree_moyenne_jours", "resolution_time_hours", "duree_estimee",
]
START_NAMES = ["timestamp", "timestamp_start", "created", "date_debut"]
END_NAMES = ["timestamp_end", "resolved", "date_fin"]
# Time resolver, any case.
MINUTES_NAMES = ["duration_minutes", "duree_minutes", "temps_minutes", "manual_time_minutes"]
HOURS_NAMES = ["duration_hours", "duree_heures", "temps_heures", "manual_time_hours"]
DAYS_NAMES = ["duration_days", "duree_jours", "duree_moyenne_jours", "temps_jours", "jours"]
CASE_NAMES = [
    "case_id", "ticket_id", "id", "process_id", "instance_id", "dossier_id",
    "lead_id", "candidate_id", "client_id", "opportunity_id", "acteur",
]
ACTIVITY_NAMES = [
    "activity", "action", "event", "step", "status",
    "content", "description", "label",
    "nom", "titre", "etape", "category",
]
TIMESTAMP_NAMES = ["timestamp", "created_at", "created", "date", "datetime", "time", "ts"]
START_TIMESTAMP_NAMES = [
    "start_timestamp", "started_at", "timestamp_start", "date_debut", "opened_at",
]
END_TIMESTAMP_NAMES = [
    "end_timestamp", "ended_at", "timestamp_end", "resolved", "date_fin", "closed_at",
]
# End of fixed values.


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def named(name: str) -> Column:
    """Reference to a column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick_exact(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    present = set(columns)
    return next((c for c in candidates if c in present), None)


def pick_any_case(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """First candidate present in any case; of twins the last column wins."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def require(df: DataFrame, needed: Iterable[str]) -> None:
    """Fail with the list of absent columns."""
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise MissingColumns(f"missing columns {absent}; available: {df.columns}")
