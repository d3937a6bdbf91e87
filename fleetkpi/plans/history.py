"""Indicators over time: what the rules say of every machine at the end of every month.

An indicator at some date takes the visits entered up to it, as the log has them now. A machine's
state changes only with its visits, so one pass over the timeline keeps, of each machine and month, the
last visit's trailing statistics and the month's sums; sums run over months, and a state is carried
forward to the months without visits. Medians of everything up to a month come from ``running_medians``.
Ages are taken at the end of each month, the last one at ``as_of`` itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import band
from ..functions.clock import elapsed_days, instant, micros, month_start, month_text
from ..operators.features import anomaly_windows, trailing_counts
from ..operators.selection import long_form, running_medians
from ..operators.timeline import NO_CUTS, Cuts, dealt, settled
from ..storage import materialise
from .anomaly import rule_points
from .forecast import rule_rates
from .fr30 import rule_risk_value
from .rul import rule_lives

#: A change below this part of the earlier value is none.
TOLERANCE = 0.05
#: Anomaly score from which a machine counts as detected in a month.
DETECTED = 0.6
_MEDIANS = {"tbf_mediana": "tbf_dias", "horas_mediana": "ciclo_horas"}


def _month_medians(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """Medians of each machine's visits up to each month it has visits in."""
    if not cuts:
        # a month's rows enter the frame together, and the value map is read once for them
        upto = Window.partitionBy("codigo").orderBy("_mes").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        medians = {name: F.percentile(c, F.lit(0.5)).over(upto) for name, c in _MEDIANS.items()}
        found = rows.select("codigo", "_mes", *[c.alias(n) for n, c in medians.items()])
        return found.groupBy("codigo", "_mes").agg(*[F.first(n).alias(n) for n in _MEDIANS])
    quiet = rows.join(cuts.machines, "codigo", "left_anti")
    busy = rows.join(cuts.machines, "codigo", "left_semi")
    found = running_medians(long_form(busy, ["codigo", "_mes"], {name: F.col(c) for name, c in _MEDIANS.items()}), ["codigo"], "_mes")
    wide = found.groupBy("codigo", "_mes").agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in _MEDIANS])
    # months that brought a machine no value keep the median before
    months = busy.select("codigo", "_mes").distinct().join(wide, ["codigo", "_mes"], "left")
    before = Window.partitionBy("codigo").orderBy("_mes").rowsBetween(Window.unboundedPreceding, 0)
    carried = months.select("codigo", "_mes", *[F.last(n, True).over(before).alias(n) for n in _MEDIANS])
    return _month_medians(quiet, NO_CUTS).unionByName(carried)


def month_states(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> tuple[DataFrame, DataFrame]:
    """Statistics of every machine as of each month in which it has visits, and the visits they were made from.

    ``_mes`` is the month's first day.
    """
    base = timeline.select("codigo", "visit_id", "fecha_in", "sistema_afectado", "clase", "tbf_dias", "ciclo_horas", "tbf_med_3", "primera_in")
    table = materialise(
        anomaly_windows(settled(base, cuts), cuts).select(
            *base.columns, "ingresos_30d", "mttr_med_30d", "sistemas_unicos_30d", month_start(F.col("fecha_in")).alias("_mes")
        )
    )
    rows = table if cuts else dealt(table, cuts)
    last = F.struct(
        F.col("fecha_in").alias("ultima_in"),
        "clase",
        "primera_in",
        F.col("tbf_med_3").alias("tbf_ultimos_3"),
        F.col("ingresos_30d").alias("n_30d"),
        F.col("mttr_med_30d").alias("horas_mediana_30d"),
        F.col("sistemas_unicos_30d").alias("sistemas_30d"),
    )
    months = rows.groupBy("codigo", "_mes").agg(
        F.count("*").alias("n"),
        F.count("tbf_dias").alias("_nt"),
        F.sum("tbf_dias").alias("_t"),
        F.sum("ciclo_horas").alias("_h"),
        F.max_by(last, F.struct("fecha_in", "visit_id")).alias("_l"),
    )
    upto = Window.partitionBy("codigo").orderBy("_mes").rowsBetween(Window.unboundedPreceding, 0)
    run = {name: F.sum(name).over(upto) for name in ("n", "_nt", "_t", "_h")}
    states = months.withColumns(run).join(_month_medians(rows, cuts), ["codigo", "_mes"])
    states = states.select(
        "codigo",
        "_mes",
        "n",
        elapsed_days(F.col("_l.ultima_in"), F.col("_l.primera_in")).alias("dias_activos"),
        F.when(F.col("_nt") > 0, F.col("_t") / F.col("_nt")).alias("tbf_media"),
        (F.col("_h") / F.col("n")).alias("horas_media"),
        *_MEDIANS,
        "_l.*",
    )
    return states, table


def fleet_states(rows: DataFrame) -> DataFrame:
    """Median TBF and mean hours of all visits up to each month; one row a month."""
    found = running_medians(long_form(rows, ["_mes"], {"flota_tbf": F.col("tbf_dias")}), [], "_mes")
    # a row a month, whatever the log's size
    upto = Window.orderBy("_mes").rowsBetween(Window.unboundedPreceding, 0)
    months = rows.groupBy("_mes").agg(F.sum("ciclo_horas").alias("_h"), F.count("ciclo_horas").alias("_n"))
    joined = months.join(found.select("_mes", F.col("median").alias("flota_tbf")), "_mes", "left")
    return joined.select(
        "_mes",
        F.last("flota_tbf", True).over(upto).alias("flota_tbf"),
        (F.sum("_h").over(upto) / F.sum("_n").over(upto)).alias("flota_horas"),
    )


def _carried(states: DataFrame, keys: Sequence[str], until: Column) -> DataFrame:
    """Each state in its own month and in those up to the next state, or to ``until``; ``mes`` is the month."""
    order = Window.partitionBy(*keys).orderBy("_mes")
    end = F.coalesce(F.add_months(F.lead("_mes").over(order), -1), until)
    months = F.explode(F.sequence(F.col("_mes"), F.col("_end"), F.expr("interval 1 month")))
    return states.withColumn("_end", end).withColumn("mes", months).drop("_end")


def indicator_history(timeline: DataFrame, as_of: str, cuts: Cuts = NO_CUTS) -> DataFrame:
    """The rules' indicators of every machine at the end of each month from its first visit on.

    ``con_visita`` marks months in which the machine was in the workshop.
    """
    states, rows = month_states(timeline, cuts)
    until = month_start(instant(as_of))
    machine = _carried(states, ["codigo"], until)
    fleet = _carried(fleet_states(rows), [], until).drop("_mes")
    joined = machine.join(F.broadcast(fleet), "mes")  # a row a month
    end = F.least(F.add_months("mes", 1).cast("timestamp"), instant(as_of))
    known = rule_points(rule_rates(rule_lives(joined, end)))
    return known.select(
        "codigo",
        month_text(F.col("mes")).alias("mes"),
        (F.col("mes") == F.col("_mes")).alias("con_visita"),
        rule_risk_value().alias("fr30_risk"),
        "rul50_d",
        "rul90_d",
        "forecast_7d_h",
        "forecast_30d_h",
        "horas_por_dia",
        F.least(F.lit(1.0), F.col("_score")).alias("anomaly_score"),
        band(F.col("_score"), "anomaly_rule").alias("anomaly_banda"),
    )


def change_label(now: Column, before: Column, up: str = "creciente", down: str = "decreciente") -> Column:
    """``up``, ``estable`` or ``down``; null where there is nothing to compare with."""
    change = F.when(before != 0, (now - before) / F.abs(before))
    return F.when(change > TOLERANCE, up).when(change < -TOLERANCE, down).when(change.isNotNull(), "estable")


def month_summary(history: DataFrame) -> DataFrame:
    """Means and sums of the fleet at each month's end, the anomalies detected in it, and four trend labels."""
    months = history.groupBy("mes").agg(
        F.count("*").alias("equipos"),
        F.avg("fr30_risk").alias("promedio_fr30"),
        F.avg("rul50_d").alias("promedio_rul50"),
        F.sum("forecast_30d_h").alias("total_horas_pronosticadas_30d"),
        F.avg("anomaly_score").alias("promedio_anomalia"),
        F.count_if(F.col("con_visita") & (F.col("anomaly_score") >= DETECTED)).alias("anomalias_detectadas_mes"),
    )
    # a row a month
    order = Window.orderBy("mes")

    def trend(name: str, *labels: str) -> Column:
        # rounded, so that a label does not hang on the order of a sum
        return change_label(F.round(name, 9), F.lag(F.round(name, 9)).over(order), *labels)

    return months.withColumns(
        {
            "fr30_trend": trend("promedio_fr30"),
            "rul_trend": trend("promedio_rul50", "mejorando", "empeorando"),
            "usage_trend": trend("total_horas_pronosticadas_30d"),
            "anomaly_trend": trend("promedio_anomalia"),
        }
    )


def risk_history(timeline: DataFrame, dates: Sequence[str], cuts: Cuts = NO_CUTS) -> DataFrame:
    """Return risk by the rules of every machine at a few given dates: codigo, fecha, risk.

    One aggregation: of each machine the last visit up to each date, with the running sums behind it.
    A machine has no row for dates before its first visit.
    """
    counted = trailing_counts(
        timeline.select("codigo", "visit_id", "fecha_in", "tbf_dias"), {"n_30d": 30}, True, cuts
    )
    found = []
    for number, date in enumerate(dates):
        seen = micros(F.col("fecha_in")) <= micros(instant(date))
        last = F.max_by(F.when(seen, F.col("n_30d")), F.when(seen, F.struct("fecha_in", "visit_id")))
        found.append(F.struct(F.lit(date).alias("fecha"), last.alias("n_30d"), F.avg(F.when(seen, F.col("tbf_dias"))).alias("tbf_media")).alias(f"_{number}"))
    states = counted.groupBy("codigo").agg(*found)
    listed = F.explode(F.array(*[F.col(f"_{n}") for n in range(len(dates))]))
    rows = states.select("codigo", listed.alias("_s")).select("codigo", "_s.*").filter(F.col("n_30d").isNotNull())
    return rows.select("codigo", "fecha", rule_risk_value().alias("risk"))


def risk_trends(timeline: DataFrame, as_of: str, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Risk of every machine now, its trends over 7 and 30 days, and its risks 14 and 7 days ago and now."""
    days = {n: str(datetime.fromisoformat(as_of) - timedelta(days=n)) for n in (0, 7, 14, 30)}
    rows = risk_history(timeline, list(days.values()), cuts)
    at = lambda n: F.max(F.when(F.col("fecha") == days[n], F.col("risk")))
    past = rows.groupBy("codigo").agg(*[at(n).alias(f"_{n}") for n in days])
    steps = F.array(*[F.when(F.col(f"_{n}").isNotNull(), F.struct(F.lit(days[n][:10]).alias("fecha"), F.col(f"_{n}").alias("risk"))) for n in (14, 7, 0)])
    return past.select(
        "codigo",
        F.col("_0").alias("risk_30d"),
        change_label(F.col("_0"), F.col("_7")).alias("trend_7d"),
        change_label(F.col("_0"), F.col("_30")).alias("trend_30d"),
        F.filter(steps, lambda s: s.isNotNull()).alias("historical_risks"),
    )
