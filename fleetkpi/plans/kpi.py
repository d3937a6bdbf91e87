"""Combined indicator tables: one row per machine in every input, so joins stay balanced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import band, colours
from ..functions.clock import month_text
from ..functions.fmt import fixed
from ..operators.machine_stats import shared_stats
from ..operators.selection import machine_aggregates
from ..operators.timeline import NO_CUTS, Cuts
from .anomaly import rule_score
from .forecast import rule_forecast
from .fr30 import rule_risk
from .rul import rule_rul

NUMBERS = ["fr30_risk", "rul50_d", "rul90_d", "forecast_7d_h", "forecast_30d_h", "horas_por_dia"]
#: What the four trained models take from a timeline; windows of other columns need not run for them.
TRAINED_ON = [
    "visit_id",
    "codigo",
    "fecha_in",
    "fecha_out",
    "sistema_afectado",
    "flota",
    "clase",
    "ciclo_horas",
    "dias_desde_ultima_salida",
    "tbf_dias",
    "anterior_in",
    "siguiente_in",
    "ultima_in",
    "n_min5",
    "tbf_med_3",
    "tbf_med_60d",
    "tbf_std_60d",
    "mttr_eq",
]


def rule_indicators(
    timeline: DataFrame, as_of: str, cuts: Cuts = NO_CUTS
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Return risk, remaining life, usage and anomaly tables by the rules, in one log pass."""
    stats, fleet = shared_stats(timeline, cuts)
    return (
        rule_risk(stats),
        rule_rul(stats, fleet, as_of),
        rule_forecast(stats, fleet),
        rule_score(stats),
    )


def fr30_columns(fr30: DataFrame) -> DataFrame:
    return fr30.select("codigo", F.col("risk_30d").alias("fr30_risk"), F.col("banda").alias("fr30_banda"))


def rul_columns(rul: DataFrame) -> DataFrame:
    return rul.select("codigo", "rul50_d", "rul90_d")


def forecast_columns(forecast: DataFrame) -> DataFrame:
    return forecast.select("codigo", "forecast_7d_h", "forecast_30d_h", "horas_por_dia")


def anomaly_columns(anomaly: DataFrame) -> DataFrame:
    return anomaly.select("codigo", "anomaly_score", F.col("banda").alias("anomaly_banda"))


def combine(fr30: DataFrame, rul: DataFrame, forecast: DataFrame, anomaly: DataFrame) -> DataFrame:
    """Every machine that has any indicator; what is missing is null.

    Counts, means and alerts take this table, so that a missing indicator counts for nothing.
    """
    parts = [
        fr30_columns(fr30),
        rul_columns(rul),
        forecast_columns(forecast),
        anomaly_columns(anomaly),
    ]
    return reduce(lambda a, b: a.join(b, "codigo", "full"), parts)


def assemble(fr30: DataFrame, rul: DataFrame, forecast: DataFrame, anomaly: DataFrame) -> DataFrame:
    """The combined table for export: missing numbers are 0, missing bands empty."""
    joined = combine(fr30, rul, forecast, anomaly)
    return joined.fillna(0.0, [*NUMBERS, "anomaly_score"]).fillna("", ["fr30_banda", "anomaly_banda"])


def all_machines(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [t.select("codigo") for t in tables]).distinct()


def _driven_by_fr30(
    fr30: DataFrame, rul: DataFrame, forecast: DataFrame, anomaly: DataFrame
) -> DataFrame:
    return (
        fr30_columns(fr30)
        .join(rul_columns(rul), "codigo", "left")
        .join(forecast_columns(forecast), "codigo", "left")
        .join(anomaly_columns(anomaly), "codigo", "left")
    )


def summary_table(
    fr30: DataFrame, rul: DataFrame, forecast: DataFrame, anomaly: DataFrame
) -> DataFrame:
    """Formatted summary of the machines that have a return risk."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("N/A"))

    return _driven_by_fr30(fr30, rul, forecast, anomaly).select(
        F.col("codigo").alias("equipo"),
        F.concat(fixed(number("fr30_risk") * 100, 1), F.lit("%")).alias("fr30"),
        text("fr30_banda").alias("banda_fr30"),
        F.concat(fixed(number("rul50_d"), 0), F.lit("d")).alias("rul50"),
        F.concat(fixed(number("rul90_d"), 0), F.lit("d")).alias("rul90"),
        F.concat(fixed(number("forecast_7d_h"), 0), F.lit("h")).alias("pronostico_7d"),
        F.concat(fixed(number("forecast_30d_h"), 0), F.lit("h")).alias("pronostico_30d"),
        fixed(number("anomaly_score"), 2).alias("anomalia"),
        text("anomaly_banda").alias("banda_anomalia"),
    )


def scatter_table(
    fr30: DataFrame,
    rul: DataFrame,
    anomaly: DataFrame,
    rul_limit: float = 30.0,
    risk_limit: float = 0.5,
) -> DataFrame:
    """Remaining life against risk and anomaly, with the quadrant."""
    joined = (
        fr30_columns(fr30)
        .join(rul_columns(rul), "codigo", "left")
        .join(anomaly_columns(anomaly), "codigo", "left")
        .fillna(0.0, ["rul50_d", "anomaly_score"])
    )
    short, risky = F.col("rul50_d") < rul_limit, F.col("fr30_risk") >= risk_limit
    quadrant = (
        F.when(short & risky, "rul_critico_riesgo_alto")
        .when(short, "rul_critico")
        .when(risky, "riesgo_alto")
        .otherwise("normal")
    )
    return joined.select(
        "codigo", "rul50_d", "fr30_risk", "anomaly_score", quadrant.alias("cuadrante")
    )


def _with_indicator() -> Column:
    """Machines that have a risk, a life or an anomaly score; usage alone does not count."""
    return F.count_if(F.coalesce("fr30_risk", "rul50_d", "anomaly_score").isNotNull())


def band_counts(kpis: DataFrame) -> DataFrame:
    """Machines per band of each indicator, of those that have it."""

    def counted(column: str, name: str, labels: dict[str, str]) -> list[Column]:
        value = F.when(F.col(column).isNotNull(), band(F.col(column), name))
        return [F.count_if(value == label).alias(alias) for alias, label in labels.items()]

    return kpis.agg(
        _with_indicator().alias("total_equipos"),
        *counted("fr30_risk", "level", {"fr30_alto": "ALTO", "fr30_medio": "MEDIO", "fr30_bajo": "BAJO"}),
        *counted(
            "rul90_d", "rul", {"rul_critico": "CRÍTICO", "rul_alerta": "ALERTA", "rul_normal": "NORMAL"}
        ),
        *counted(
            "anomaly_score",
            "anomaly",
            {
                "anomalia_alta": "🔴 ALTO (≥80%)",
                "anomalia_media": "🟠 MEDIO (60-79%)",
                "anomalia_baja": "🟢 BAJO (<60%)",
            },
        ),
    )


def executive_summary(kpis: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """One row: counts, means and sums of the fleet.

    With ``months`` (``history.month_summary``) also the anomalies detected in its last month and the
    four trends against the month before.
    """
    summary = kpis.agg(
        _with_indicator().alias("total_equipos"),
        F.count_if(F.col("fr30_risk") >= 0.5).alias("equipos_alto_riesgo"),
        F.count_if(F.col("rul90_d") < 7).alias("equipos_mantenimiento_urgente"),
        F.count_if(F.col("anomaly_score") >= 0.6).alias("equipos_con_anomalias"),
        F.avg("fr30_risk").alias("promedio_fr30"),
        F.avg("rul50_d").alias("promedio_rul50"),
        F.sum("forecast_30d_h").alias("total_horas_pronosticadas_30d"),
    )
    if months is None:
        return summary
    names = ("anomalias_detectadas_mes", "fr30_trend", "rul_trend", "usage_trend", "anomaly_trend")
    last = months.agg(F.max_by(F.struct(*names), "mes").alias("_m")).select("_m.*")
    return summary.crossJoin(F.broadcast(last))  # one row


def band_distribution(kpis: DataFrame) -> DataFrame:
    """Machines per band for return risk and anomaly, in long form."""
    kinds = {"fr30": ("fr30_risk", "fr30_live"), "anomaly": ("anomaly_score", "anomaly_live")}
    pairs = F.filter(
        F.array(
            *[
                F.when(
                    F.col(column).isNotNull(),
                    F.struct(F.lit(kpi).alias("kpi"), band(F.col(column), name).alias("banda")),
                )
                for kpi, (column, name) in kinds.items()
            ]
        ),
        lambda p: p.isNotNull(),
    )
    return (
        kpis.select(F.explode(pairs).alias("_p"))
        .groupBy("_p.kpi", "_p.banda")
        .agg(F.count("*").alias("equipos"))
    )


def bi_measures(kpis: DataFrame) -> DataFrame:
    high = F.avg((F.col("fr30_risk") >= 0.5).cast("double")) * 100
    return kpis.agg(
        F.coalesce(high, F.lit(0.0)).alias("equipos_alto_riesgo_pct"),
        F.avg("rul50_d").alias("rul_promedio"),
    )


def maintenance_alerts(kpis: DataFrame) -> DataFrame:
    known = kpis.filter(F.col("rul50_d").isNotNull())
    return known.select("codigo", "rul50_d", band(F.col("rul50_d"), "bi").alias("alerta"))


def alerts(kpis: DataFrame) -> DataFrame:
    """One row per machine and alert that applies; limits are the site's."""
    tests = {
        "alto_riesgo_fr30": (F.col("fr30_risk") > 0.4, F.col("fr30_risk")),
        "rul_critico": (F.col("rul50_d") < 20, F.col("rul50_d")),
        "anomalia": (F.col("anomaly_score") > 0.5, F.col("anomaly_score")),
    }
    raised = F.filter(
        F.array(
            *[
                F.when(test, F.struct(F.lit(name).alias("alerta"), value.alias("valor")))
                for name, (test, value) in tests.items()
            ]
        ),
        lambda a: a.isNotNull(),
    )
    return kpis.select("codigo", F.explode(raised).alias("_a")).select("codigo", "_a.*")


def alert_means(kpis: DataFrame) -> DataFrame:
    return kpis.agg(
        F.avg("fr30_risk").alias("fr30_promedio"),
        F.avg("rul50_d").alias("rul50_promedio"),
        F.avg("anomaly_score").alias("anomalia_promedio"),
    )


def basic_estimate(
    timeline: DataFrame, year_month: str, hours: str = "mttr_horas", cuts: Cuts = NO_CUTS
) -> DataFrame:
    """Plain estimates for machines with at least three visits, and their visits in a month."""
    start = F.lit(f"{year_month}-01").cast("date")
    in_month = (F.col("fecha_in") >= start.cast("timestamp")) & (
        F.col("fecha_in") < F.add_months(start, 1).cast("timestamp")
    )
    plain = [F.count("*").alias("_n"), F.count_if(in_month).alias("_month")]
    medians = {"_t": F.col("tbf_dias"), "_m": F.col(hours)}
    stats = machine_aggregates(timeline, plain, medians, cuts).filter(F.col("_n") >= 3)
    enough = F.col("_n") >= 5
    calm = F.col("anomaly_score") < 0.3
    return stats.withColumn("anomaly_score", F.least(F.lit(0.8), F.col("_month") * 0.2)).select(
        "codigo",
        F.when(enough, 0.25).otherwise(0.15).alias("risk_30d"),
        F.when(enough, "🟠 MEDIO").otherwise("🟢 BAJO").alias("fr30_banda"),
        F.greatest(F.lit(30.0), F.col("_t") * 0.7).alias("rul50_d"),
        F.greatest(F.lit(15.0), F.col("_t") * 0.5).alias("rul90_d"),
        (F.col("_m") * 0.5).alias("forecast_7d_h"),
        (F.col("_m") * 2).alias("forecast_30d_h"),
        "anomaly_score",
        F.when(calm, "🟢 NORMAL").otherwise("🟠 ATENCIÓN").alias("anomaly_banda"),
    )


def trend_label(
    monthly: DataFrame, value: str, key: str | None = None, tolerance: float = 0.05
) -> DataFrame:
    """Change against the previous month as creciente / estable / decreciente.

    ``monthly`` holds one row per month (and key), so the window is small.
    """
    order = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("mes")
    before = F.lag(value).over(order)
    change = (F.col(value) - F.col("anterior")) / F.abs(F.col("anterior"))
    return (
        monthly.withColumn("anterior", before)
        .withColumn("cambio", F.when(F.col("anterior") != 0, change))
        .withColumn(
            "tendencia",
            F.when(F.col("cambio") > tolerance, "creciente")
            .when(F.col("cambio") < -tolerance, "decreciente")
            .when(F.col("cambio").isNotNull(), "estable"),
        )
    )


def monthly_value(df: DataFrame, key: str, ts: str, measure: str) -> DataFrame:
    return df.groupBy(key, month_text(F.col(ts)).alias("mes")).agg(F.avg(measure).alias("valor"))


def bi_flat(kpis: DataFrame) -> DataFrame:
    """Flat table for BI tools: plain band names, colours and priorities, and the row count."""
    dim = colours(kpis.sparkSession)
    score = F.col("anomaly_score")
    anomaly = F.when(score >= 0.8, "ALTO").when(score >= 0.6, "MEDIO").otherwise("BAJO")
    rows = kpis.withColumns(
        {"fr30_nivel": band(F.col("fr30_risk"), "level"), "anomaly_nivel": anomaly}
    )
    total = kpis.agg(F.count("*").alias("total_records"))
    first = dim.select(
        F.col("banda").alias("fr30_nivel"),
        F.col("color").alias("fr30_color"),
        F.col("prioridad").alias("fr30_prioridad"),
    )
    second = dim.select(F.col("banda").alias("anomaly_nivel"), F.col("color").alias("anomaly_color"))
    flat = rows.join(F.broadcast(first), "fr30_nivel", "left").join(  # three rows
        F.broadcast(second), "anomaly_nivel", "left"
    )
    return flat.crossJoin(F.broadcast(total)).select(
        F.col("codigo").alias("equipo"),
        "fr30_risk",
        "fr30_nivel",
        "fr30_color",
        "fr30_prioridad",
        "rul50_d",
        "rul90_d",
        "forecast_7d_h",
        "forecast_30d_h",
        "anomaly_score",
        "anomaly_nivel",
        "anomaly_color",
        "total_records",
    )

