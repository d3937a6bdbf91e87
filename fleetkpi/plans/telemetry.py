"""Scores from machine telemetry: trained regressors, closed forms and the risk trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from ..functions.clock import instant
from ..functions.fmt import exact_round, fixed
from ..operators.forest import IsolationForest, decision, fit_forest, score_forest
from ..operators.regression_forest import RegressionForest, fit_regression_forest, predict
from ..storage import materialise

FEATURES = ["temperatura", "vibracion", "horas_operacion", "ciclos_trabajo", "dia_anio"]
TARGETS = {"prob_falla_30d": "fr30_pred", "rul_estimado": "rul_pred"}
#: What tells readings apart; tables without it draw by all of their values.
KEY = "lectura_id"


def _key(telemetry: DataFrame) -> list[str]:
    return [KEY] if KEY in telemetry.columns else [c for c in ("equipo", "fecha", *FEATURES) if c in telemetry.columns]


def fit(telemetry: DataFrame, trees: int = 20, depth: int = 10, seed: int = 42) -> RegressionForest:
    """A regression forest per target; both are grown in the same passes.

    Trees split by order alone, so the features need no scaling.
    """
    return fit_regression_forest(telemetry, FEATURES, list(TARGETS), _key(telemetry), trees, depth, seed)


def score(model: RegressionForest, telemetry: DataFrame) -> DataFrame:
    """Failure probability within 0..1 and whole days of remaining life."""
    return (
        predict(telemetry, model, list(TARGETS.values()))
        .withColumns(
            {
                "fr30_risk": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fr30_pred"))),
                "rul_days": F.greatest(F.lit(0), F.col("rul_pred").cast("bigint")),
            }
        )
        .drop(*TARGETS.values())
    )


def fit_anomaly(telemetry: DataFrame, trees: int = 100, seed: int = 42) -> IsolationForest:
    """Rows are drawn by their key where they have one, so the trees do not depend on partitions."""
    return fit_forest(telemetry, FEATURES, [KEY] if KEY in telemetry.columns else None, trees, seed=seed)


def score_anomaly(forest: IsolationForest, telemetry: DataFrame) -> DataFrame:
    """Decision score turned to 0..1 with 1 as the most anomalous, and its band."""
    scored = decision(materialise(score_forest(telemetry, forest))).drop("score")
    return scored.withColumn("anomaly_score", (F.lit(1.0) - F.col("decision")) / 2).withColumn(
        "banda", band(F.col("anomaly_score"), "anomaly_live")
    )


def closed_form(telemetry: DataFrame, variant: str = "additive") -> DataFrame:
    """Scores computed from temperature, vibration and hours without any training."""
    temp, vib, hours = (F.col(c) for c in ("temperatura", "vibracion", "horas_operacion"))
    zero, one = F.lit(0.0), F.lit(1.0)
    if variant == "additive":
        risk = F.least(one, (vib * 0.1 + F.greatest(zero, temp - 80) * 0.01 + hours * 0.02) / 10)
        life = F.greatest(
            F.lit(10), (F.lit(200) - vib * 20 - F.greatest(zero, temp - 85) * 3).cast("bigint")
        )
        anomaly = F.least(one, (vib + F.greatest(zero, temp - 75)) / 100)
    elif variant == "weighted":
        mixed = (
            F.greatest(zero, (temp - 70) / 30) * 0.4
            + F.least(one, vib / 5) * 0.4
            + F.least(one, hours / 20) * 0.2
        )
        risk = F.greatest(F.lit(0.05), F.least(F.lit(0.95), mixed))
        wear = (temp - 65) / 100 + vib / 10
        life = F.greatest(F.lit(15), (F.lit(180) - wear * 100).cast("bigint"))
        anomaly = F.greatest(
            F.lit(-1.0), F.least(one, F.abs(temp - 75) / 50 + vib / 10 - 0.5)
        )
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return telemetry.withColumns({"fr30_risk": risk, "rul_days": life, "anomaly_score": anomaly})


def trend(telemetry: DataFrame) -> DataFrame:
    """Line through the mean failure probability by day of year."""
    by_day = telemetry.groupBy("dia_anio").agg(F.avg("prob_falla_30d").alias("_p"))
    x = F.col("dia_anio").cast("double")
    return by_day.agg(
        F.regr_slope("_p", x).alias("pendiente"), F.regr_intercept("_p", x).alias("intercepto")
    )


def daily_risk(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("equipo", F.col("fecha").cast("date").alias("fecha")).agg(
        F.avg("prob_falla_30d").alias("riesgo")
    )


# fixed values: what the payload says of each indicator
EXPLANATIONS = {
    "fr30": "RandomForest ML - Predicción para %s",
    "rul": "ML Regression - Vida útil para %s",
    "anomaly": "Isolation Forest - Detección anomalías %s",
    "forecast": "ML Time Series - Pronóstico para %s",
}


def _bounded(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def project(telemetry: DataFrame, as_of: str, days: int = 30, history: int = 30) -> DataFrame:
    """Each machine's risk over the last days and its linear projection, tagged by kind.

    The projection starts from the last observed risk and follows the slope of the history.
    """
    today = instant(as_of).cast("date")
    recent = daily_risk(
        telemetry.filter(
            (F.col("fecha") >= F.date_sub(today, history - 1).cast("timestamp"))
            & (F.col("fecha") < F.date_add(today, 1).cast("timestamp"))
        )
    )
    offset = F.datediff(F.col("fecha"), today).cast("double")
    lines = recent.groupBy("equipo").agg(
        F.coalesce(F.regr_slope("riesgo", offset), F.lit(0.0)).alias("_slope"),
        F.max_by("riesgo", "fecha").alias("_last"),
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_i")
    ahead = lines.select("equipo", "_slope", "_last", steps).select(
        "equipo",
        F.date_add(today, F.col("_i")).alias("fecha"),
        _bounded(F.col("_last") + F.col("_slope") * F.col("_i")).alias("riesgo"),
        F.lit("pronóstico").alias("tipo"),
    )
    seen = recent.select("equipo", "fecha", _bounded(F.col("riesgo")).alias("riesgo"), F.lit("histórico").alias("tipo"))
    return seen.unionByName(ahead)


def month_kpis(telemetry: DataFrame, year_month: str, as_of: str) -> DataFrame:
    """Indicator payload per machine from its mean readings of a month.

    The closed form's anomaly score counts as one between -1 and 1 and is brought to 0..1.
    """
    start = F.lit(f"{year_month}-01").cast("date")
    rows = telemetry.filter(
        (F.col("fecha") >= start.cast("timestamp"))
        & (F.col("fecha") < F.add_months(start, 1).cast("timestamp"))
    )
    means = rows.groupBy("equipo").agg(
        *[F.round(F.avg(c), 9).alias(c) for c in ("temperatura", "vibracion", "horas_operacion")]
    )
    scored = closed_form(means)
    ahead = (
        project(telemetry, as_of, 7)
        .filter(F.col("tipo") == "pronóstico")
        .groupBy("equipo")
        .agg(F.round(F.avg("riesgo") * 100, 9).alias("_week"))
    )
    risk, week = F.col("fr30_risk"), F.col("_week")
    anomaly = (F.col("anomaly_score") + 1) / 2
    return (
        scored.join(ahead, "equipo", "left")
        .select(
            "equipo",
            exact_round(risk, 3).alias("risk_30d"),
            F.concat(fixed(risk * 100, 1), F.lit("%")).alias("risk_percentage"),
            band(risk, "fr30_live").alias("status"),
            band(risk, "badge_risk").alias("badge_color"),
            F.col("rul_days").alias("rul50_d"),
            (F.col("rul_days") * 0.7).cast("bigint").alias("rul90_d"),
            exact_round(anomaly, 2).alias("anomaly_score"),
            band(anomaly, "anomaly_live").alias("anomaly_status"),
            band(anomaly, "badge_anomaly").alias("anomaly_color"),
            exact_round(week, 1).alias("forecast_7d"),
            exact_round(week * 4.2, 1).alias("forecast_30d"),
            F.when(week > 20, "Ascendente").otherwise("Estable").alias("trend_direction"),
            *[F.format_string(text, F.col("equipo")).alias(f"explicacion_{kpi}") for kpi, text in EXPLANATIONS.items()],
        )
    )


