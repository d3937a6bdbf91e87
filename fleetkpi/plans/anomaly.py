"""Anomaly score per machine: isolation forest over visit windows, or simple rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import NO_DATA, band
from ..operators.features import (
    anomaly_windows,
    calendar_parts,
    period_labels,
)
from ..operators.forest import IsolationForest, decision, fit_forest, score_forest
from ..operators.machine_stats import machine_stats
from ..operators.timeline import NO_CUTS, Cuts, settled
from ..storage import materialise

FEATURES = [
    "ingresos_30d",
    "ingresos_60d",
    "tbf_med_30d",
    "tbf_std_30d",
    "tbf_min_30d",
    "tbf_max_30d",
    "tbf_med_60d",
    "tbf_trend",
    "sistemas_unicos_30d",
    "sistema_dominante_30d",
    "diversidad_sistemas_30d",
    "sistemas_unicos_60d",
    "mttr_med_30d",
    "mttr_std_30d",
    "mttr_max_30d",
    "mttr_med_90d",
    "dia_semana",
    "mes",
    "es_fin_semana",
    "ratio_actividad_30_60",
    "cambio_tbf",
    "cambio_mttr",
]
KEY_FEATURES = [
    "ingresos_30d",
    "ingresos_60d",
    "tbf_med_30d",
    "tbf_trend",
    "sistemas_unicos_30d",
    "mttr_med_30d",
    "ratio_actividad_30_60",
    "cambio_tbf",
    "cambio_mttr",
]
MIN_FEATURE_ROWS = 10


def feature_table(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> DataFrame:
    """The 22 features of every visit from a machine's fifth on, with the period label.

    ``mttr_med_90d`` is taken over 60 days; the name is the customary one.
    """
    base = timeline.select(
        "codigo", "fecha_in", "visit_id", "sistema_afectado", "tbf_dias", "ciclo_horas", "n_min5"
    )
    labelled = period_labels(settled(base, cuts), cuts=cuts)
    windows = anomaly_windows(labelled, cuts)
    return (
        calendar_parts(windows.filter("n_min5"))
        .withColumnsRenamed(
            {"tbf_med_60d_rango": "tbf_med_60d", "mttr_med_90d_rango": "mttr_med_90d"}
        )
        .select("codigo", F.col("fecha_in").alias("fecha"), "visit_id", "periodo", *FEATURES)
    )


def normalise(df: DataFrame, column: str, name: str = "normalizado") -> DataFrame:
    """Scale to 0..1 with 1 for the lowest value; all equal gives 0."""
    value = F.col(column)
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise(
        F.lit(1) - (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    )
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, share).drop("_lo", "_hi")  # one row


def fit(features: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationForest:
    return fit_forest(features, FEATURES, ["visit_id"], trees, sample, seed)


def score(features: DataFrame, forest: IsolationForest) -> DataFrame:
    """Normalised score of every feature row and whether it is in the most anomalous tenth."""
    # written once: the limit and the bounds are taken from the written scores
    scored = decision(materialise(score_forest(features, forest)))
    return normalise(scored, "decision", "anomaly_score").withColumn(
        "anomala", F.col("decision") < 0
    )


def latest_scores(machines: DataFrame, scored: DataFrame) -> DataFrame:
    """Latest scored row per machine with its key features; machines without rows get no band."""
    picked = ["anomaly_score", "fecha", *KEY_FEATURES]
    last = scored.groupBy("codigo").agg(
        F.max_by(F.struct(*picked), F.struct("fecha", (-F.col("visit_id")).alias("first"))).alias("_l")
    )
    score_of = F.coalesce(F.col("_l.anomaly_score"), F.lit(0.0))
    return (
        machines.select("codigo")
        .distinct()
        .join(last, "codigo", "left")
        .select(
            "codigo",
            score_of.alias("anomaly_score"),
            F.when(F.col("_l").isNull(), NO_DATA)
            .otherwise(band(F.col("_l.anomaly_score"), "anomaly"))
            .alias("banda"),
            *[F.col("_l")[c].alias(c) for c in KEY_FEATURES],
            F.date_format(F.col("_l.fecha"), "yyyy-MM-dd").alias("fecha_analisis"),
        )
    )


def rule_points(stats: DataFrame) -> DataFrame:
    """Points for busy, short-lived, scattered and slow recent visits.

    Adds ``ingresos_promedio`` and the sum of the points as ``_score``.
    """
    usual = F.col("n") / F.greatest(F.lit(1.0), F.col("dias_activos") / 30)

    def points(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(0.0)

    total = (
        points(F.col("n_30d") > F.col("ingresos_promedio") * 2, 0.4)
        + points(F.col("tbf_ultimos_3") < F.col("tbf_mediana") * 0.5, 0.3)
        + points(F.col("sistemas_30d") > 2, 0.2)
        + points(F.col("horas_mediana_30d") > F.col("horas_mediana") * 1.5, 0.1)
    )
    return stats.withColumn("ingresos_promedio", usual).withColumn("_score", total)


def rule_score(stats: DataFrame) -> DataFrame:
    """The rule's score of every machine."""
    return rule_points(stats).select(
        "codigo",
        F.least(F.lit(1.0), F.col("_score")).alias("anomaly_score"),
        band(F.col("_score"), "anomaly_rule").alias("banda"),
        F.col("n_30d").alias("ingresos_recientes"),
        "ingresos_promedio",
        F.coalesce("tbf_ultimos_3", F.lit(0.0)).alias("tbf_reciente"),
        F.col("sistemas_30d").alias("sistemas_recientes"),
    )


def detect(timeline: DataFrame, cuts: Cuts = NO_CUTS, **options) -> DataFrame:
    """Forest score where there are enough feature rows, rule score elsewhere."""
    features = materialise(feature_table(timeline, cuts))
    if features.limit(MIN_FEATURE_ROWS).count() < MIN_FEATURE_ROWS:
        return rule_score(machine_stats(timeline)).select("codigo", "anomaly_score", "banda")
    scored = score(features, fit(features, **options))
    return latest_scores(timeline, scored).select("codigo", "anomaly_score", "banda")
