"""Remaining useful life: Weibull survival by machine class, fitted inside the query."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from ..functions.clock import elapsed_days, instant
from ..operators.machine_stats import shared_stats
from ..operators.timeline import NO_CUTS, Cuts
from ..storage import materialise

MIN_INTERVALS = 5
_STEPS = 200


def intervals(timeline: DataFrame, max_days: int = 1000) -> DataFrame:
    """Gaps between consecutive visits, all observed failures; needs ``tbf_dias``."""
    gap = F.col("tbf_dias")
    return timeline.filter((gap > 0) & (gap < max_days)).select(
        "codigo",
        gap.cast("bigint").alias("duration"),
        F.lit(1).alias("event"),
        F.coalesce("clase", F.lit("GENERAL")).alias("clase"),
        F.coalesce("flota", F.lit("GENERAL")).alias("flota"),
        F.col("anterior_in").alias("fecha_inicio"),
        F.col("fecha_in").alias("fecha_evento"),
    )


def _weibull(histogram: DataFrame) -> DataFrame:
    """Maximum likelihood by fixed point on each class's (duration, n) pairs.

    There are fewer than ``max_days`` distinct durations, so a class is a short array whatever
    the number of visits. Durations are scaled by their maximum to keep the powers in range.
    """
    pair = F.struct(F.col("duration").cast("double").alias("x"), F.col("n").cast("double").alias("n"))
    grouped = histogram.groupBy("clase").agg(
        F.collect_list(pair).alias("_h"),
        F.sum("n").alias("n_observaciones"),
        F.max("duration").cast("double").alias("_top"),
        F.min(F.struct("primer_codigo", "primera_fecha")).alias("aparicion"),
        (F.sum(F.col("n") * F.col("duration")) / F.sum("n")).alias("duracion_media"),
    )
    h = F.array_sort(F.col("_h"))
    scaled = grouped.withColumn(
        "_h",
        F.transform(
            h,
            lambda e: F.struct(
                (e["x"] / F.col("_top")).alias("x"),
                F.ln(e["x"] / F.col("_top")).alias("lx"),
                e["n"].alias("n"),
            ),
        ),
    )

    def total(f) -> Column:
        return F.aggregate(F.col("_h"), F.lit(0.0), lambda acc, e: acc + e["n"] * f(e))

    # a class with one distinct duration has no finite shape
    usable = scaled.filter((F.col("n_observaciones") >= MIN_INTERVALS) & (F.size("_h") > 1))
    logs = usable.withColumn("_ml", total(lambda e: e["lx"]) / F.col("n_observaciones"))

    def step(k: Column, _: Column) -> Column:
        sums = F.aggregate(
            F.col("_h"),
            F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
            lambda acc, e: F.struct(
                (acc["a"] + e["n"] * F.pow(e["x"], k)).alias("a"),
                (acc["b"] + e["n"] * F.pow(e["x"], k) * e["lx"]).alias("b"),
            ),
            lambda acc: acc["b"] / acc["a"],
        )
        return (k + F.try_divide(F.lit(1.0), sums - F.col("_ml"))) / 2

    rounds = F.sequence(F.lit(1), F.lit(_STEPS))
    shaped = logs.withColumn("k", F.aggregate(rounds, F.lit(1.0), step))
    scale = F.col("_top") * F.pow(
        total(lambda e: F.pow(e["x"], F.col("k"))) / F.col("n_observaciones"), F.lit(1.0) / F.col("k")
    )
    return shaped.filter(F.col("k").isNotNull() & ~F.isnan("k")).select(
        "clase", scale.alias("lambda"), "k", "n_observaciones", "duracion_media", "aparicion"
    )


def duration_histogram(gaps: DataFrame) -> DataFrame:
    """Interval counts per class and length; combined before the shuffle."""
    return gaps.groupBy("clase", "duration").agg(
        F.count("*").alias("n"),
        F.min(F.struct("codigo", "fecha_evento")).alias("_f"),
    ).select(
        "clase",
        "duration",
        "n",
        F.col("_f.codigo").alias("primer_codigo"),
        F.col("_f.fecha_evento").alias("primera_fecha"),
    )


def fit_weibull(gaps: DataFrame) -> DataFrame:
    """Parameters per class with enough intervals; one GLOBAL row where no class has.

    The histogram holds fewer than ``max_days`` rows per class, so it is written once and the
    log is read once.
    """
    by_class = materialise(duration_histogram(gaps))
    fitted = _weibull(by_class)
    pooled = by_class.groupBy("duration").agg(
        F.lit("GLOBAL").alias("clase"),
        F.sum("n").alias("n"),
        F.min("primer_codigo").alias("primer_codigo"),
        F.min("primera_fecha").alias("primera_fecha"),
    )
    enough = by_class.groupBy("clase").agg(
        ((F.sum("n") >= MIN_INTERVALS) & (F.count("*") > 1)).alias("_ok")
    )
    none = enough.agg(F.coalesce(F.max("_ok"), F.lit(False)).alias("_any")).filter(~F.col("_any"))
    fallback = _weibull(pooled).crossJoin(F.broadcast(none)).drop("_any")  # at most one row
    return fitted.unionByName(fallback)


def with_class_parameters(latest: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters of the machine's class, else GLOBAL, else those of the first class seen."""
    names = ("lambda", "k", "n_observaciones", "duracion_media")
    values = [F.col(n) for n in names]
    default = params.agg(
        F.min_by(
            F.struct(F.col("clase").alias("modelo_usado"), *values),
            F.struct((F.col("clase") != "GLOBAL").alias("later"), F.col("aparicion")),
        ).alias("_default")
    )
    own = params.select(
        "clase", F.struct(F.col("clase").alias("modelo_usado"), *values).alias("_own")
    )
    joined = latest.join(own, "clase", "left").crossJoin(F.broadcast(default))  # one row
    chosen = F.coalesce("_own", "_default")
    return joined.withColumn("_m", chosen).select(
        *latest.columns, *[F.col("_m")[n].alias(n) for n in ("modelo_usado", *names)]
    )


def _life(age: Column, q: float) -> Column:
    """Days until the survival given the age falls to q, in units of the scale against overflow."""
    k, scale = F.col("k"), F.col("lambda")
    return scale * F.pow(F.pow(age / scale, k) - math.log(q), F.lit(1.0) / k) - age


def _age(as_of: str, ts: str = "fecha_in") -> Column:
    return F.greatest(F.lit(0.0), elapsed_days(instant(as_of), F.col(ts)))


def remaining_life(
    latest: DataFrame, params: DataFrame, as_of: str, q50: float = 0.5, q90: float = 0.1
) -> DataFrame:
    """Days to the survival quantiles, given the days since the last visit.

    ``q90=0.1`` is the formula in use, which makes rul90 the larger of the two; pass 0.9 for the
    conservative reading.
    """
    rows = with_class_parameters(latest, params).withColumn("edad_actual_d", _age(as_of))
    age = F.greatest(F.lit(1.0), F.col("edad_actual_d"))

    def bounded(q: float, factor: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(_life(age, q), F.col("lambda") * factor))

    return rows.withColumns({"rul50_d": bounded(q50, 2.0), "rul90_d": bounded(q90, 3.0)}).select(
        "codigo",
        "rul50_d",
        "rul90_d",
        "edad_actual_d",
        "clase",
        "modelo_usado",
        "lambda",
        "k",
        "n_observaciones",
    )


def rule_lives(rows: DataFrame, as_of: Column | str) -> DataFrame:
    """Life from the machine's median TBF, the fleet's, or 30 days, less its age at ``as_of``.

    Adds ``tbf_base``, ``edad_actual_d``, ``rul50_d`` and ``rul90_d`` to rows with the statistics of both.
    """

    def positive(column: Column, other: Column) -> Column:
        return F.when(column > 0, column).otherwise(other)

    base = positive(F.col("tbf_mediana"), positive(F.col("flota_tbf"), F.lit(30.0)))
    age = elapsed_days(instant(as_of), F.col("ultima_in"))
    floor = F.lit(1.0)
    return rows.withColumns({"tbf_base": base, "edad_actual_d": age}).withColumns(
        {
            "rul50_d": F.greatest(floor, F.col("tbf_base") * 0.7 - F.col("edad_actual_d") * 0.5),
            "rul90_d": F.greatest(floor, F.col("tbf_base") * 0.9 - F.col("edad_actual_d") * 0.3),
        }
    )


def rule_rul(stats: DataFrame, fleet: DataFrame, as_of: str) -> DataFrame:
    """The rule's life of every machine.

    ``stats`` and ``fleet`` come from ``machine_stats`` and ``fleet_stats``.
    """
    rows = rule_lives(stats.crossJoin(F.broadcast(fleet)), as_of)  # one row
    return rows.select(
        "codigo",
        "rul50_d",
        "rul90_d",
        "edad_actual_d",
        "clase",
        F.lit("SIMPLE").alias("modelo_usado"),
        "tbf_base",
    )


def life_table(timeline: DataFrame, as_of: str, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Weibull life where at least one model could be fitted, the rule elsewhere."""
    stats, fleet = shared_stats(timeline, cuts)
    latest = stats.select("codigo", F.col("ultima_in").alias("fecha_in"), "clase")
    params = fit_weibull(intervals(timeline))
    columns = ["rul50_d", "rul90_d", "edad_actual_d", "clase", "modelo_usado"]
    fitted = remaining_life(latest, params, as_of).select(
        "codigo", F.when(F.col("lambda").isNotNull(), F.struct(*columns)).alias("_w")
    )
    rule = rule_rul(stats, fleet, as_of).select("codigo", F.struct(*columns).alias("_r"))
    chosen = rule.join(fitted, "codigo", "left").withColumn("_c", F.coalesce("_w", "_r"))
    return chosen.select("codigo", *[F.col("_c")[c].alias(c) for c in columns])


def survival_curve(params: DataFrame, days: Sequence[int] = (10, 30, 60)) -> DataFrame:
    """S(t) at the chosen days, with the lives at 90, 50 and 10 % survival."""

    def life(q: float) -> Column:
        return F.col("lambda") * F.pow(F.lit(-math.log(q)), F.lit(1.0) / F.col("k"))

    t = F.explode(F.array(*[F.lit(float(d)) for d in days]))
    return (
        params.select("clase", "lambda", "k", t.alias("dias"))
        .withColumn(
            "probabilidad", F.exp(-F.pow(F.col("dias") / F.col("lambda"), F.col("k")))
        )
        .withColumns(
            {"rul_s90_d": life(0.9), "rul_s50_d": life(0.5), "rul_s10_d": life(0.1)}
        )
    )


def maintenance_window(rul: DataFrame, hours_per_day: Column | None = None) -> DataFrame:
    """Best days to intervene and their urgency; hours left where daily use is known."""
    rul50, rul90 = F.col("rul50_d"), F.col("rul90_d")
    result = rul.withColumns(
        {
            "ventana_optima_inicio": F.greatest(F.lit(1), (rul90 * 0.7).cast("bigint")),
            "ventana_optima_fin": (rul50 * 0.9).cast("bigint"),
            "urgencia": band(rul90, "window"),
        }
    )
    if hours_per_day is None:
        return result
    used = hours_per_day > 0
    return result.withColumns(
        {
            "rul50_h": F.when(used, rul50 * hours_per_day),
            "rul90_h": F.when(used, rul90 * hours_per_day),
        }
    )
