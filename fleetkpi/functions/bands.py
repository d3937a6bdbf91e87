"""Band sets and their labels. Thresholds differ between reports on purpose; all are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BandSet:
    """Limits are tried in order; ``op`` compares the value with each limit."""

    op: str
    limits: tuple[tuple[float, str], ...]
    otherwise: str
    missing: str | None = None


NO_DATA = "⚪ SIN DATO"

# ---- fixed values: thresholds and labels ----
BANDS = {
    "fr30": BandSet(
        ">=", ((0.5, "🔴 ALTO (≥50%)"), (0.3, "🟠 MEDIO (30-49%)")), "🟢 BAJO (<30%)", NO_DATA
    ),
    "fr30_live": BandSet(">=", ((0.5, "🔴 ALTO"), (0.25, "🟠 MEDIO")), "🟢 BAJO"),
    "anomaly": BandSet(
        ">=", ((0.8, "🔴 ALTO (≥80%)"), (0.6, "🟠 MEDIO (60-79%)")), "🟢 BAJO (<60%)", NO_DATA
    ),
    "anomaly_rule": BandSet(
        ">=", ((0.6, "🔴 ALTO (≥60%)"), (0.4, "🟠 MEDIO (40-59%)")), "🟢 BAJO (<40%)"
    ),
    "anomaly_live": BandSet(">=", ((0.6, "🔴 CRÍTICO"), (0.3, "🟡 ATENCIÓN")), "🟢 NORMAL"),
    "state": BandSet(">", ((70.0, "CRÍTICO"), (50.0, "ALTO")), "MODERADO"),
    "rul": BandSet("<", ((7.0, "CRÍTICO"), (21.0, "ALERTA")), "NORMAL"),
    "window": BandSet("<", ((7.0, "ALTA"), (21.0, "MEDIA")), "BAJA"),
    "bi": BandSet("<=", ((14.0, "🔴 URGENTE"), (30.0, "🟠 PRÓXIMO")), "🟢 OK"),
    "badge_risk": BandSet(">=", ((0.5, "danger"), (0.25, "warning")), "success"),
    "badge_anomaly": BandSet(">=", ((0.6, "danger"), (0.3, "warning")), "success"),
    "usage": BandSet(">", ((16.0, "MUY ALTA"), (12.0, "ALTA"), (8.0, "MEDIA")), "BAJA"),
    "level": BandSet(">=", ((0.5, "ALTO"), (0.3, "MEDIO")), "BAJO"),
}

# band, colour, priority
BAND_COLOURS = [
    ("ALTO", "#DC3545", 3),
    ("MEDIO", "#FFC107", 2),
    ("BAJO", "#28A745", 1),
]


def band(value: Column, name: str) -> Column:
    spec = BANDS[name]
    compare = {
        ">=": lambda limit: value >= limit,
        ">": lambda limit: value > limit,
        "<=": lambda limit: value <= limit,
        "<": lambda limit: value < limit,
    }[spec.op]
    cases = F.when(value.isNull(), F.lit(spec.missing)) if spec.missing else None
    for limit, label in spec.limits:
        test = compare(F.lit(limit))
        cases = cases.when(test, label) if cases is not None else F.when(test, label)
    return cases.otherwise(spec.otherwise)


def urgency(rul50: Column, rul90: Column) -> Column:
    """Urgency of an intervention; the last limit looks at the median life."""
    return (
        F.when(rul90 < 7, "CRÍTICA")
        .when(rul90 < 21, "ALTA")
        .when(rul50 < 45, "MEDIA")
        .otherwise("BAJA")
    )


def colours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BAND_COLOURS, "banda string, color string, prioridad int")
