"""Per-machine and fleet statistics that the rule-based indicators share.

One aggregation over the visit timeline serves all four rules; afterwards there is one row per
machine, and the rules are projections of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import elapsed_days
from ..storage import materialise
from .selection import global_medians, machine_aggregates
from .timeline import NO_CUTS, Cuts

_COLUMNS = (
    "codigo",
    "visit_id",
    "fecha_in",
    "sistema_afectado",
    "clase",
    "tbf_dias",
    "ciclo_horas",
    "ultima_in",
    "tbf_med_3",
)


def machine_stats(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Counts, means and medians of every machine, overall and in the 30 days up to its last visit.

    Medians of machines that are cut are selected, the others keep their distinct values; all
    aggregates combine before the shuffle.
    """
    recent = F.col("fecha_in") >= F.col("ultima_in") - F.expr("interval 30 days")

    def lately(name: str) -> Column:
        return F.when(recent, F.col(name))

    last = F.struct("fecha_in", "clase", "tbf_med_3")
    plain = [
        F.count("*").alias("n"),
        F.count_if(recent).alias("n_30d"),
        elapsed_days(F.max("fecha_in"), F.min("fecha_in")).alias("dias_activos"),
        F.avg("tbf_dias").alias("tbf_media"),
        F.avg("ciclo_horas").alias("horas_media"),
        F.size(F.collect_set(lately("sistema_afectado"))).alias("sistemas_30d"),
        F.max_by(last, F.struct("fecha_in", "visit_id")).alias("_last"),
    ]
    medians = {
        "tbf_mediana": F.col("tbf_dias"),
        "horas_mediana": F.col("ciclo_horas"),
        "horas_mediana_30d": lately("ciclo_horas"),
    }
    stats = machine_aggregates(timeline, plain, medians, cuts)
    return stats.select(
        *[c for c in stats.columns if c != "_last"],
        F.col("_last.fecha_in").alias("ultima_in"),
        F.col("_last.clase").alias("clase"),
        F.col("_last.tbf_med_3").alias("tbf_ultimos_3"),
    )


def fleet_stats(timeline: DataFrame) -> DataFrame:
    """One row: median TBF and mean repair hours over all visits."""
    hours = timeline.agg(F.avg("ciclo_horas").alias("flota_horas"))
    return global_medians(timeline, {"flota_tbf": F.col("tbf_dias")}).crossJoin(F.broadcast(hours))


def shared_stats(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> tuple[DataFrame, DataFrame]:
    """Machine and fleet statistics, computed once for several indicators."""
    rows = materialise(timeline.select(*_COLUMNS))
    return materialise(machine_stats(rows, cuts)), fleet_stats(rows)
