"""Checks and audit of diagnoses (V4, V5).

``diagnoses`` has one row per process: titles, key metrics, potential and a nullable
``gains`` struct. ``steps`` is (process_id, id, nom, type_etape, acteur, ..., friction?).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import non_blank, parse_percent, strip
from tracemill.operators.metrics import LEVELS
from tracemill.operators.roi import MONTHS, ROI_MODES, ROUNDING_TOLERANCE
from tracemill.operators.rules import duplicates, union_all, violations, warnings_array

# Fixed values.
STEP_TYPES = ["manuelle", "automatisable", "semi-automatisable"]
POTENTIALS = ["faible", "moyen", "élevé", "très élevé"]
MIN_STEPS, MAX_OPPORTUNITIES = 3, 5
MANUAL_LOW, MANUAL_HIGH = 10, 90
LONG_PAYBACK_MONTHS = 24
# End of fixed values.

_LEVEL_FIELDS = [
    "monthly_volume", "manual_time_minutes", "activity_duration_minutes",
    "case_cycle_time_minutes", "waiting_time_minutes",
]


def step_violations(steps: DataFrame) -> DataFrame:
    """Texts and types of steps, unique ids, unique (name, actor)."""
    texts = violations(
        steps,
        "step",
        "process_id",
        "id",
        {
            "id_blank": ~non_blank("id"),
            "name_blank": ~non_blank("nom"),
            "actor_blank": ~non_blank("acteur"),
            "friction_blank": F.col("friction").isNotNull() & ~non_blank("friction"),
            "type_not_allowed": ~F.coalesce(F.col("type_etape").isin(STEP_TYPES), F.lit(False)),
        },
    )
    ids = violations(
        duplicates(steps, ["process_id", "id"]), "step", "process_id", "id", {"duplicate_id": F.lit(True)}
    )
    signed = steps.select(
        "process_id", F.lower(strip("nom")).alias("nom"), F.lower(strip("acteur")).alias("acteur")
    )
    twins = violations(
        duplicates(signed, ["process_id", "nom", "acteur"]),
        "step",
        "process_id",
        F.concat_ws("/", "nom", "acteur"),
        {"duplicate_name_and_actor": F.lit(True)},
    )
    return union_all([texts, ids, twins])


def _with_blank(items: Column) -> Column:
    return F.coalesce(F.exists(items, lambda x: ~non_blank(x)), F.lit(False))


def gain_rules(tol: float) -> dict[str, Column]:
    """Rules of the gains block; skipped where it is null."""
    present = F.col("gains").isNotNull()
    g = {
        n: F.col(f"gains.{n}")
        for n in (
            "heures_economisees_par_mois", "economies_mensuelles_devise", "projection_annuelle",
            "mois_retour_investissement", "detail_du_calcul", "assumptions", "principales_opportunites",
        )
    }
    mode = F.col("gains.confidence.roi_mode")
    rules = {
        f"{n}_negative": g[n] < 0
        for n in ("heures_economisees_par_mois", "economies_mensuelles_devise", "projection_annuelle")
    }
    rules |= {
        "payback_not_positive": g["mois_retour_investissement"] <= 0,
        "annual_not_12_months": F.abs(
            g["projection_annuelle"] - g["economies_mensuelles_devise"] * MONTHS
        ) > tol,
        "calculation_blank": ~non_blank(g["detail_du_calcul"]),
        "assumptions_empty": F.coalesce(F.size(g["assumptions"]), F.lit(0)) <= 0,
        "assumption_blank": _with_blank(g["assumptions"]),
        "roi_mode_not_allowed": ~F.coalesce(mode.isin(ROI_MODES), F.lit(False)),
        "opportunities_empty": F.coalesce(F.size(g["principales_opportunites"]), F.lit(0)) <= 0,
        "opportunity_blank": _with_blank(g["principales_opportunites"]),
    }
    rules |= {
        f"{f}_level_not_allowed": ~F.coalesce(F.col(f"gains.confidence.{f}").isin(LEVELS), F.lit(False))
        for f in _LEVEL_FIELDS
    }
    return {name: present & cond for name, cond in rules.items()}


def roi_match_rules(tol: float) -> dict[str, Column]:
    """Gains must repeat the computed savings (joined as ``_roi``)."""
    present = F.col("gains").isNotNull() & F.col("_roi").isNotNull()
    pairs = {
        "heures_economisees_par_mois": "heures_economisees_par_mois",
        "economies_mensuelles": "economies_mensuelles_devise",
        "projection_annuelle": "projection_annuelle",
    }
    rules = {
        f"{g}_differs_from_roi": ~F.coalesce(
            F.abs(F.col(f"gains.{g}") - F.col(f"_roi.{r}")) <= tol, F.lit(False)
        )
        for r, g in pairs.items()
    }
    rules["assumptions_differ_from_roi"] = ~F.col("gains.assumptions").eqNullSafe(F.col("_roi.assumptions"))
    fields = ["roi_mode", *_LEVEL_FIELDS]
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"gains.confidence.{f}").eqNullSafe(F.col(f"_roi.confidence.{f}"))
    rules["confidence_differs_from_roi"] = ~same
    return {name: present & cond for name, cond in rules.items()}


def diagnosis_violations(
    diagnoses: DataFrame,
    steps: DataFrame,
    roi: DataFrame | None = None,
    annual_tol: float = ROUNDING_TOLERANCE,
    tol: float = 1e-6,
) -> DataFrame:
    """V4: all rules of diagnoses; ``roi`` adds equality with the computed savings."""
    counts = steps.groupBy("process_id").agg(F.count(F.lit(1)).alias("_steps"))
    rows = diagnoses.join(counts, "process_id", "left")
    rules = {
        "no_steps": F.col("_steps").isNull(),
        "potential_not_allowed": ~F.coalesce(F.col("potentiel_automatisation").isin(POTENTIALS), F.lit(False)),
        **{
            f"{c}_blank": ~non_blank(c)
            for c in (
                "titre_processus", "description", "volume_total",
                "duree_totale_estimee", "taux_manuel", "principale_friction",
            )
        },
        "manual_share_unreadable": non_blank("taux_manuel") & parse_percent("taux_manuel").isNull(),
        **gain_rules(annual_tol),
    }
    if roi is not None:
        body = F.struct(*[c for c in roi.columns if c != "process_id"]).alias("_roi")
        rows = rows.join(roi.select("process_id", body), "process_id", "left")
        rules |= roi_match_rules(tol)
    return violations(rows, "diagnosis", "process_id", None, rules).unionByName(step_violations(steps))


def audit_diagnoses(diagnoses: DataFrame, steps: DataFrame) -> DataFrame:
    """V5: warnings per process."""
    counts = steps.groupBy("process_id").agg(F.count(F.lit(1)).alias("_steps"))
    share = parse_percent("taux_manuel")
    return diagnoses.join(counts, "process_id", "left").select(
        "process_id",
        warnings_array(
            {
                "few_steps": F.coalesce("_steps", F.lit(0)) < MIN_STEPS,
                "many_opportunities": F.size("gains.principales_opportunites") > MAX_OPPORTUNITIES,
                "manual_share_low": share < MANUAL_LOW,
                "manual_share_high": share > MANUAL_HIGH,
                "manual_share_unreadable": share.isNull(),
                "long_payback": F.col("gains.mois_retour_investissement") > LONG_PAYBACK_MONTHS,
            }
        ).alias("warnings"),
    )
