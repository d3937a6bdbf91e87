"""Report tables: groupings that combine before the shuffle, ties in top lists broken by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import month_text
from .selection import machine_aggregates
from .timeline import NO_CUTS, Cuts

_WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _most_common(column: str) -> Column:
    """Most frequent value, the lowest of equally frequent ones."""
    return F.expr(f"mode() within group (order by {column})")


def machine_summary(df: DataFrame, hours: str = "mttr_horas", cuts: Cuts = NO_CUTS) -> DataFrame:
    """Visits, medians, last visit and most common system and attention per machine.

    ``mode`` keeps a map of systems per machine, combined before the shuffle; so do the medians of
    machines that are not cut, and those of the others are selected.
    """
    plain = [
        F.count("*").alias("total_ingresos"),
        F.max("fecha_in").alias("ultimo_ingreso"),
        F.coalesce(_most_common("sistema_afectado"), F.lit("N/A")).alias("sistema_principal"),
        F.coalesce(_most_common("tipo_atencion"), F.lit("N/A")).alias("tipo_atencion_principal"),
    ]
    medians = {"tbf_promedio": F.col("tbf_dias"), "mttr_promedio": F.col(hours)}
    return machine_aggregates(df, plain, medians, cuts)


def top_counts(df: DataFrame, key: str, k: int, share: bool = False) -> DataFrame:
    """The k most frequent values; ``share`` adds their percentage of all rows."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("total"))
    top = counts.orderBy(F.col("total").desc(), key).limit(k)
    if not share:
        return top
    rows = df.agg(F.count("*").alias("_rows"))
    return (
        top.crossJoin(F.broadcast(rows))  # one row
        .withColumn("porcentaje", F.col("total") / F.col("_rows") * 100)
        .drop("_rows")
    )


def top_means(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """The k largest group means."""
    means = df.groupBy(key).agg(F.avg(measure).alias("promedio"))
    # rounded before ranking so that the ranking does not hang on summation order
    return means.orderBy(F.round("promedio", 6).desc(), key).limit(k)


def monthly(df: DataFrame, ts: str = "fecha_in") -> DataFrame:
    return df.groupBy(month_text(F.col(ts)).alias("mes")).agg(F.count("*").alias("ingresos"))


def monthly_mean(df: DataFrame, measure: str, ts: str = "fecha_in") -> DataFrame:
    return df.groupBy(month_text(F.col(ts)).alias("mes")).agg(F.avg(measure).alias("promedio"))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Monthly visits with their 3-month mean; the window sees one row a month."""
    frame = Window.orderBy("mes").rowsBetween(-2, 0)
    everything = Window.partitionBy()
    full = (F.count("*").over(frame) == 3) & (F.count("*").over(everything) > 3)
    return monthly(df).withColumn("tendencia_3m", F.when(full, F.avg("ingresos").over(frame)))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins over [low, high)."""
    width = (high - low) / bins
    bin_no = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins))
    return (
        df.groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count("*").alias("filas"))
        .withColumn("desde", F.lit(low) + (F.col("bin") - 1) * F.lit(width))
        .withColumn("hasta", F.lit(low) + F.col("bin") * F.lit(width))
    )


def five_number(df: DataFrame, by: str, measure: str, groups: int = 5) -> DataFrame:
    """Minimum, quartiles and maximum for the first few groups by name."""
    probs = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])
    names = ("minimo", "q1", "mediana", "q3", "maximo")
    stats = df.groupBy(by).agg(F.percentile(measure, probs).alias("_p"))
    return (
        stats.orderBy(by)
        .limit(groups)
        .select(by, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    )


def heatmap(df: DataFrame, ts: str = "fecha_in") -> DataFrame:
    """Visits by weekday and hour, every weekday and hour present."""
    spine = df.sparkSession.createDataFrame(
        list(enumerate(_WEEKDAYS)), "orden int, dia_semana string"
    )
    counts = (
        df.withColumn("_hora", F.hour(ts))
        .groupBy(F.weekday(ts).alias("orden"))
        .pivot("_hora", list(range(24)))
        .agg(F.count(F.lit(1)))
    )
    hours = {str(h): F.coalesce(F.col(str(h)), F.lit(0)) for h in range(24)}
    return spine.join(counts, "orden", "left").select(
        "orden", "dia_semana", *[c.alias(f"h{int(n):02d}") for n, c in hours.items()]
    )


def mttr_tbf_pairs(df: DataFrame) -> DataFrame:
    return df.filter(F.col("tbf_dias").isNotNull()).select("codigo", "tbf_dias", "ciclo_horas")


def busy_enough(df: DataFrame, minimum: int = 5, k: int = 10) -> DataFrame:
    """Machines with at least ``minimum`` visits, the k busiest."""
    counts = df.groupBy("codigo").agg(F.count("*").alias("total")).filter(F.col("total") >= minimum)
    return counts.orderBy(F.col("total").desc(), "codigo").limit(k)


def telemetry_top(telemetry: DataFrame, k: int = 5, month: int | None = None) -> DataFrame:
    """Machines with the highest mean failure probability, beside the fleet's mean and size."""
    rows = telemetry if month is None else telemetry.filter(F.month("fecha") == month)
    means = (
        rows.groupBy("equipo")
        .agg(
            F.avg("prob_falla_30d").alias("_p"),
            *[F.avg(c).alias(c) for c in ("temperatura", "vibracion", "horas_operacion")],
        )
        .withColumn("prob_falla_pct", F.round(F.col("_p") * 100, 6))
        .drop("_p")
    )
    fleet = means.agg(
        F.avg("prob_falla_pct").alias("promedio_riesgo"), F.count("*").alias("total_equipos")
    )
    pct = F.col("prob_falla_pct")
    state = F.when(pct > 70, "CRÍTICO").when(pct > 50, "ALTO").otherwise("MODERADO")
    return (
        means.orderBy(pct.desc(), "equipo")
        .limit(k)
        .withColumn("estado", state)
        .crossJoin(F.broadcast(fleet))  # one row
    )


def day_of_year_means(telemetry: DataFrame) -> DataFrame:
    measures = ("temperatura", "vibracion", "horas_operacion", "ciclos_trabajo", "prob_falla_30d")
    return telemetry.groupBy("dia_anio").agg(*[F.avg(c).alias(c) for c in measures])


def usage_variability(df: DataFrame, key: str = "codigo", measure: str = "ciclo_horas") -> DataFrame:
    """Mean, deviation and coefficient of variation per machine."""
    mean, deviation = F.avg(measure), F.stddev_samp(measure)
    return df.groupBy(key).agg(
        mean.alias("uso_promedio"),
        deviation.alias("desviacion"),
        F.when(mean > 0, deviation / mean).alias("coef_variacion"),
    )

