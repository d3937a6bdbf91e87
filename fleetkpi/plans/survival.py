"""Survival with open intervals: product-limit estimate, censored Weibull, and how well one fits the other.

The time from a machine's last visit to ``as_of`` is an interval that has not ended. Intervals are counted
by class and whole days first, so a class is a short table however long the log is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import elapsed_days, instant
from ..operators.features import latest_per_machine
from ..storage import materialise
from .rul import intervals

MIN_EVENTS = 5
#: Halvings of the range of shapes; the last one is below the accuracy of a double.
_HALVINGS = 60
_SHAPES = (0.01, 100.0)


def censored_intervals(timeline: DataFrame, as_of: str, max_days: int = 1000) -> DataFrame:
    """codigo, clase, duration and event: ended gaps (1), and for each machine the open one since its last visit (0).

    An open interval above ``max_days`` is cut off there, as longer gaps are no intervals; one of less than
    a day says nothing and is left out.
    """
    ended = intervals(timeline, max_days).select("codigo", "clase", "duration", "event")
    last = latest_per_machine(timeline.select("codigo", "fecha_in", "visit_id", "clase"))
    age = F.least(elapsed_days(instant(as_of), F.col("fecha_in")), F.lit(float(max_days)))
    opened = last.select(
        "codigo", F.coalesce("clase", F.lit("GENERAL")).alias("clase"), age.cast("bigint").alias("duration"), F.lit(0).alias("event")
    )
    return ended.unionByName(opened.filter(F.col("duration") > 0))


def life_table(found: DataFrame) -> DataFrame:
    """Of each class and duration: intervals that ended, were open, or were at risk; written."""
    days = found.groupBy("clase", "duration").agg(F.sum("event").alias("eventos"), F.sum(1 - F.col("event")).alias("abiertos"))
    after = Window.partitionBy("clase").orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    return materialise(days.withColumn("en_riesgo", F.sum(F.col("eventos") + F.col("abiertos")).over(after)))


def product_limit(days: DataFrame) -> DataFrame:
    """Share that survives each duration, and Greenwood's standard error of it."""
    upto = Window.partitionBy("clase").orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    ended, risk = F.col("eventos"), F.col("en_riesgo")
    gone = F.max((ended == risk).cast("int")).over(upto) == 1
    kept = F.exp(F.sum(F.when(ended < risk, F.ln(1 - ended / risk))).over(upto))
    spread = F.sum(F.when(ended < risk, ended / (risk * (risk - ended)))).over(upto)
    survives = F.when(gone, 0.0).otherwise(kept)
    rows = days.withColumns({"supervivencia": survives, "_g": spread})
    return rows.withColumn("error", F.col("supervivencia") * F.sqrt(F.coalesce("_g", F.lit(0.0)))).drop("_g")


def fit_censored(days: DataFrame) -> DataFrame:
    """lambda and k of each class with events of more than one length: the maximum of the censored likelihood.

    The score falls with the shape, so halving its range finds the one root; ``residuo`` is what is left of it.
    """
    pair = F.struct(F.col("duration").cast("double").alias("x"), F.col("eventos").alias("d"), (F.col("eventos") + F.col("abiertos")).alias("n"))
    grouped = days.groupBy("clase").agg(
        F.array_sort(F.collect_list(pair)).alias("_h"),
        F.max("duration").cast("double").alias("_top"),
        F.sum("eventos").alias("n_eventos"),
        F.sum("abiertos").alias("n_abiertos"),
        F.count_if(F.col("eventos") > 0).alias("_lengths"),
    )
    usable = grouped.filter((F.col("n_eventos") >= MIN_EVENTS) & (F.col("_lengths") > 1))
    # durations by the largest one, so that powers stay in range
    scaled = F.transform(
        "_h", lambda e: F.struct((e["x"] / F.col("_top")).alias("x"), F.ln(e["x"] / F.col("_top")).alias("l"), e["d"].alias("d"), e["n"].alias("n"))
    )
    rows = usable.withColumn("_h", scaled)
    rows = rows.withColumn("_ml", F.aggregate("_h", F.lit(0.0), lambda t, e: t + e["d"] * e["l"]) / F.col("n_eventos"))

    def score(k: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
        sums = F.aggregate(
            "_h", zero, lambda t, e: F.struct((t["a"] + e["n"] * F.pow(e["x"], k)).alias("a"), (t["b"] + e["n"] * F.pow(e["x"], k) * e["l"]).alias("b"))
        )
        return F.lit(1.0) / k + F.col("_ml") - sums["b"] / sums["a"]

    def halved(range_: Column, _: Column) -> Column:
        middle = (range_["lo"] + range_["hi"]) / 2
        above = score(middle) > 0
        return F.struct(F.when(above, middle).otherwise(range_["lo"]).alias("lo"), F.when(above, range_["hi"]).otherwise(middle).alias("hi"))

    first = F.struct(F.lit(_SHAPES[0]).alias("lo"), F.lit(_SHAPES[1]).alias("hi"))
    rounds = F.sequence(F.lit(1), F.lit(_HALVINGS))
    shaped = rows.withColumn("k", F.aggregate(rounds, first, halved, lambda r: (r["lo"] + r["hi"]) / 2))
    total = F.aggregate("_h", F.lit(0.0), lambda t, e: t + e["n"] * F.pow(e["x"], F.col("k")))
    return shaped.select(
        "clase",
        (F.col("_top") * F.pow(total / F.col("n_eventos"), 1 / F.col("k"))).alias("lambda"),
        "k",
        "n_eventos",
        "n_abiertos",
        F.abs(score(F.col("k"))).alias("residuo"),
    )


def fit_quality(days: DataFrame, params: DataFrame) -> DataFrame:
    """``params`` with the largest distance between the product-limit estimate and the Weibull, and 1 less it.

    Also the days after which a half is left by the estimate (null if never), and the lives at 90, 50 and
    10 % survival by the Weibull: the interval that holds four machines in five.
    """
    steps = product_limit(days)
    before = F.coalesce(F.lag("supervivencia").over(Window.partitionBy("clase").orderBy("duration")), F.lit(1.0))
    curve = steps.withColumn("_antes", before).join(params, "clase")
    model = F.exp(-F.pow(F.col("duration") / F.col("lambda"), F.col("k")))
    # the estimate is a staircase, so both ends of each step count
    away = F.greatest(F.abs(F.col("supervivencia") - model), F.abs(F.col("_antes") - model))
    distance = curve.groupBy("clase").agg(
        F.max(away).alias("distancia"), F.min(F.when(F.col("supervivencia") <= 0.5, F.col("duration"))).alias("mediana_km")
    )

    def life(q: float) -> Column:
        return F.col("lambda") * F.pow(-F.ln(F.lit(q)), 1 / F.col("k"))

    return (
        params.join(distance, "clase")
        .withColumn("fit_quality", 1 - F.col("distancia"))
        .withColumns({"rul90_d": life(0.9), "rul50_d": life(0.5), "rul10_d": life(0.1)})
        .withColumn("confidence_interval", F.array("rul90_d", "rul10_d"))
    )
