"""Expected workshop hours over the next 7 and 30 days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant
from ..operators import daily
from ..storage import materialise

HORIZON = 30
_WEEK = range(7)
_EFFECTS = daily.EFFECTS


def machine_days(timeline: DataFrame) -> DataFrame:
    """Hours, visits and the last class of every machine and entry day."""
    return timeline.groupBy("codigo", F.col("fecha_in").cast("date").alias("dia")).agg(
        F.sum("ciclo_horas").alias("horas"),
        F.count("*").alias("visitas"),
        F.max_by("clase", F.struct("fecha_in", "visit_id")).alias("clase"),
    )


def _by_machine(days: DataFrame, steps: Callable, schema: str) -> DataFrame:
    """What the steps make of each machine's days."""
    # few days grow into many: a fixed count keeps the partitions from being merged before that
    wide = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(zip(daily.INPUTS, ("string", "date", "double", "bigint", "string"), strict=True))
    rows = days.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return rows.repartition(wide, "codigo").sortWithinPartitions("codigo", "dia").mapInArrow(steps, schema)


def _each_day(packed: DataFrame) -> DataFrame:
    """A row for each day of packed series."""
    rest = [c for c in packed.columns if c not in ("codigo", "clase", "desde", "y")]
    rows = packed.select("codigo", "clase", "desde", *rest, F.posexplode("y").alias("_at", "y"))
    return rows.select("codigo", F.date_add("desde", F.col("_at")).alias("ds"), "y", "clase", *rest)


def daily_hours(days: DataFrame, min_visits: int = 3) -> DataFrame:
    """Hours by entry day and every empty day between, for machines with enough visits.

    A machine is filled in one array, so no calendar is joined; it has at most one row per calendar day.
    """
    return _each_day(_by_machine(days, daily.daily(min_visits), daily.HOURS))


def usage_series(days: DataFrame, min_visits: int = 3) -> DataFrame:
    """Smoothed, capped daily series of machines with some variation, with its statistics."""
    return _each_day(_by_machine(days, daily.usage(min_visits), daily.SERIES))


def usage_trends(days: DataFrame, min_visits: int = 3) -> DataFrame:
    """Trend and weekday effects of each machine's usage series, taken where the series is made."""
    return _by_machine(days, daily.trends(min_visits), daily.FITS)


def _trend_and_week(series: DataFrame, key: str) -> DataFrame:
    """Linear trend over days plus the mean residual of every weekday, in one aggregation.

    The mean residual of a weekday is its mean value minus the trend at its mean day.
    """
    day = F.datediff(F.col("ds"), F.lit("1970-01-01").cast("date")).cast("double")
    rows = series.withColumns({"_x": day, "_w": F.weekday("ds")})
    parts = []
    for d in _WEEK:
        mine = F.col("_w") == d
        parts += [
            F.avg(F.when(mine, F.col("_x"))).alias(f"_x{d}"),
            F.avg(F.when(mine, F.col("y"))).alias(f"_y{d}"),
        ]
    fitted = rows.groupBy(key).agg(
        F.regr_slope("y", "_x").alias("pendiente"),
        F.avg("_x").alias("dia_medio"),
        F.avg("y").alias("media"),
        F.max("ds").alias("ultimo_dia"),
        F.count("*").alias("dias"),
        *parts,
    )
    trend = lambda x: F.col("media") + F.col("pendiente") * (x - F.col("dia_medio"))
    effects = {
        name: F.coalesce(F.col(f"_y{d}") - trend(F.col(f"_x{d}")), F.lit(0.0))
        for d, name in zip(_WEEK, _EFFECTS)
    }
    return fitted.select(
        key,
        "pendiente",
        "dia_medio",
        "media",
        "ultimo_dia",
        "dias",
        *[c.alias(n) for n, c in effects.items()],
    ).filter(F.col("pendiente").isNotNull())


def fit_trend_week(series: DataFrame, min_days: int = 15) -> DataFrame:
    """A model per machine with enough days."""
    return _trend_and_week(series, "codigo").filter(F.col("dias") >= min_days)


def fit_class(series: DataFrame, min_days: int = 10) -> DataFrame:
    """A model per class from the mean daily value of at least two machines."""
    pooled = series.groupBy("clase", "ds").agg(F.avg("y").alias("y"))
    members = series.groupBy("clase").agg(F.count_distinct("codigo").alias("equipos_en_clase"))
    return (
        _trend_and_week(pooled, "clase")
        .filter(F.col("dias") >= min_days)
        .join(members.filter(F.col("equipos_en_clase") >= 2), "clase")
    )


def models(series: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """Machine models, and class models where under 30 % of the series got their own.

    ``trends`` are the series' ``usage_trends`` where they are at hand.
    """
    fits = materialise(_trend_and_week(series, "codigo") if trends is None else trends)  # one row per machine
    numbers = ["pendiente", "dia_medio", "media", "ultimo_dia", *_EFFECTS]
    individual = fits.filter(F.col("dias") >= 15).select(
        F.col("codigo").alias("modelo"), F.lit("individual").alias("tipo"), *numbers
    )
    own, every = fits.agg(F.count_if(F.col("dias") >= 15), F.count("*")).first()
    if own >= every * 0.3:
        return individual
    by_class = fit_class(series).select(
        F.concat(F.lit("CLASE_"), "clase").alias("modelo"), F.lit("clase").alias("tipo"), *numbers
    )
    return individual.unionByName(by_class)


def horizon(fitted: DataFrame, as_of: str) -> DataFrame:
    """Hours of every model over the 7 and 30 days after ``as_of``.

    A model reaches 30 days past its last observation, so one that has been silent for longer
    adds nothing and its daily rate falls back to its mean.
    """
    today = instant(as_of).cast("date")
    day = F.col("ds")
    x = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double")
    effect = F.element_at(F.array(*[F.col(n) for n in _EFFECTS]), F.weekday(day) + 1)
    value = F.col("media") + F.col("pendiente") * (x - F.col("dia_medio")) + effect
    days = F.sequence(F.date_add("ultimo_dia", 1), F.date_add("ultimo_dia", HORIZON))
    future = fitted.withColumn("ds", F.explode(days)).withColumn("yhat", value)

    def within(n: int) -> Column:
        inside = (day > today) & (day <= F.date_add(today, n))
        return F.greatest(F.lit(0.0), F.coalesce(F.sum(F.when(inside, F.col("yhat"))), F.lit(0.0)))

    return (
        future.groupBy("modelo", "tipo", "media")
        .agg(within(7).alias("forecast_7d_h"), within(30).alias("forecast_30d_h"))
        .withColumn(
            "horas_por_dia",
            F.when(F.col("forecast_30d_h") > 0, F.col("forecast_30d_h") / 30).otherwise(
                F.col("media")
            ),
        )
        .drop("media")
    )


def choose_models(machines: DataFrame, fitted: DataFrame) -> DataFrame:
    """Every machine's own model, else its class's, else the first there is."""
    values = [c for c in fitted.columns if c != "modelo"]
    packed = fitted.select("modelo", F.struct("modelo", *values).alias("_m"))
    own = packed.select(F.col("modelo").alias("codigo"), F.col("_m").alias("_own"))
    # class models alone can match a class: a handful of rows
    pooled = packed.filter(F.col("_m.tipo") == "clase").select(
        F.col("modelo").alias("_class"), F.col("_m").alias("_pooled")
    )
    first = fitted.agg(
        F.min_by(F.struct("modelo", *values), F.struct((F.col("tipo") == "clase").alias("c"), "modelo")).alias("_first")
    )
    return (
        machines.withColumn("_class", F.concat(F.lit("CLASE_"), "clase"))
        .join(own, "codigo", "left")
        .join(pooled, "_class", "left")
        .crossJoin(F.broadcast(first))  # one row
        .withColumn("_m", F.coalesce("_own", "_pooled", "_first"))
        .select("codigo", F.col("_m.modelo").alias("modelo_usado"), *[F.col("_m")[v].alias(v) for v in values])
    )


def predict(timeline: DataFrame, as_of: str) -> DataFrame:
    """Forecast of every machine with the model chosen for it."""
    days = materialise(machine_days(timeline))
    machines = days.groupBy("codigo").agg(F.max_by("clase", "dia").alias("clase"))
    ahead = horizon(models(usage_series(days), usage_trends(days)), as_of)
    confident = F.when(F.col("tipo") == "individual", "ALTA").otherwise("MEDIA")
    return (
        choose_models(machines, ahead)
        .withColumn("confianza", confident)
        .withColumnRenamed("tipo", "tipo_modelo")
    )


def rule_rates(rows: DataFrame) -> DataFrame:
    """Mean hours scaled by recent activity; the fleet's mean, or 8, where undefined.

    Adds ``factor_actividad``, ``horas_por_dia`` and both forecasts to rows with the statistics of both.
    """

    def positive(column: Column, other: Column) -> Column:
        return F.when(column > 0, column).otherwise(other)

    mean = positive(F.col("horas_media"), positive(F.col("flota_horas"), F.lit(8.0)))
    factor = F.least(F.lit(2.0), F.greatest(F.lit(0.1), F.col("n_30d") / F.lit(30.0) * 7))
    rate = F.col("horas_por_dia")
    return (
        rows.withColumn("factor_actividad", F.when(F.col("n_30d") > 0, factor).otherwise(1.0))
        .withColumn("horas_por_dia", mean * F.col("factor_actividad"))
        .withColumns({"forecast_7d_h": rate * 7, "forecast_30d_h": rate * 30})
    )


def rule_forecast(stats: DataFrame, fleet: DataFrame) -> DataFrame:
    """The rule's usage of every machine."""
    return rule_rates(stats.crossJoin(F.broadcast(fleet))).select(  # one row
        "codigo",
        "forecast_7d_h",
        "forecast_30d_h",
        "horas_por_dia",
        F.lit("SIMPLE").alias("modelo_usado"),
        F.lit("fallback").alias("tipo_modelo"),
        F.lit("BAJA").alias("confianza"),
        "factor_actividad",
    )


def machine_mean_forecast(timeline: DataFrame) -> DataFrame:
    """Plain mean hours a day, 8 where undefined: the last resort for a single machine."""
    mean = F.avg("ciclo_horas")
    rate = F.when(mean > 0, mean).otherwise(8.0)
    return timeline.groupBy("codigo").agg(rate.alias("horas_por_dia")).select(
        "codigo",
        (F.col("horas_por_dia") * 7).alias("forecast_7d_h"),
        (F.col("horas_por_dia") * 30).alias("forecast_30d_h"),
        "horas_por_dia",
        F.lit("FALLBACK").alias("modelo_usado"),
        F.lit("simple").alias("tipo_modelo"),
        F.lit("BAJA").alias("confianza"),
    )


def recommend(forecast: DataFrame, rul: DataFrame, as_of: str) -> DataFrame:
    """Service date, availability risk and advice from forecast and remaining life."""
    rate, rul50, rul90 = F.col("horas_por_dia"), F.col("rul50_d"), F.col("rul90_d")
    days = F.when(
        (rate > 0) & (rul50 > 0), F.greatest(F.lit(1), (rul50 * 0.8).cast("bigint"))
    ).otherwise(15)
    risk = F.when(rul90 < 7, "ALTO").when((rul50 < 14) & (rate > 12), "MEDIO").otherwise("BAJO")
    n = F.col("dias_hasta_servicio").cast("string")
    text = (
        F.when(
            F.col("riesgo_disponibilidad") == "ALTO",
            F.concat(
                F.lit("🔴 URGENTE: Programar mantenimiento en "),
                n,
                F.lit(" días. Alta probabilidad de falla."),
            ),
        )
        .when(
            F.col("riesgo_disponibilidad") == "MEDIO",
            F.concat(
                F.lit("🟠 ATENCIÓN: Ventana de "),
                n,
                F.lit(" días para mantenimiento. Monitorear uso intensivo."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("🟢 NORMAL: Mantenimiento programado en "), n, F.lit(" días. Operación estable.")
            )
        )
    )
    joined = forecast.select("codigo", "horas_por_dia").join(
        rul.select("codigo", "rul50_d", "rul90_d"), "codigo"
    )
    return (
        joined.withColumns({"dias_hasta_servicio": days.cast("bigint"), "riesgo_disponibilidad": risk})
        .withColumns(
            {
                "fecha_servicio_sugerida": F.date_add(
                    instant(as_of).cast("date"), F.col("dias_hasta_servicio").cast("int")
                ),
                "horas_proyectadas": rate * F.col("dias_hasta_servicio"),
                "recomendacion": text,
            }
        )
        .select(
            "codigo",
            "fecha_servicio_sugerida",
            "dias_hasta_servicio",
            "riesgo_disponibilidad",
            "horas_proyectadas",
            "recomendacion",
        )
    )
