"""Derived columns and per-machine windows over the cleaned visit log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clock import DAY_US, elapsed_days, elapsed_hours, instant, micros
from ..schema import DEFAULT_REPAIR_HOURS, DEFAULT_TYPE, TYPE_FACTORS
from .selection import global_medians, machine_aggregates
from .sliding import DDL, trailing_statistics
from .timeline import (
    NO_CUTS,
    Cuts,
    machine_window,
    own_rows,
    running_totals,
    settled,
    spread,
    with_neighbours,
)

_ORDER = ("fecha_in", "visit_id")


# ---------------------------------------------------------------- row expressions


def repair_hours(default: float = DEFAULT_REPAIR_HOURS) -> Column:
    """Hours between entry and exit; open visits count as a day."""
    return F.coalesce(elapsed_hours(F.col("fecha_out"), F.col("fecha_in")), F.lit(default))


def days_since_exit(as_of: str) -> Column:
    return elapsed_days(instant(as_of), F.coalesce(F.col("fecha_out"), F.col("fecha_in")))


def stay_measures(df: DataFrame) -> DataFrame:
    """Whole days and hours in the workshop; recorded repair hours, else the stay."""
    hours = elapsed_hours(F.col("fecha_out"), F.col("fecha_in"))
    recorded = F.col("mttr_horas") if "mttr_horas" in df.columns else F.lit(None).cast("double")
    return df.withColumns(
        {
            "duracion_taller_dias": elapsed_days(F.col("fecha_out"), F.col("fecha_in")),
            "duracion_taller_horas": hours,
            "mttr_horas": F.coalesce(recorded, hours),
        }
    )


def calendar_parts(df: DataFrame, ts: str = "fecha_in") -> DataFrame:
    weekday = F.weekday(ts)  # Monday is 0
    return df.withColumns(
        {
            "mes": F.month(ts),
            "dia_semana": weekday,
            "hora_ingreso": F.hour(ts),
            "es_fin_semana": (weekday >= 5).cast("int"),
        }
    )


def tbf_ratio(tbf: Column, median: Column) -> Column:
    return F.when(median > 0, tbf / median).otherwise(F.lit(1.0))


def recorded_tbf(df: DataFrame) -> DataFrame:
    """TBF from the log's own counters where it has them, else from the entry dates.

    Days come from ``dias_desde_averia`` or the gap to the previous entry (``tbf_dias``);
    hours from ``horas_desde_averia`` or eight working hours a day.
    """
    present = set(df.columns)
    days = F.col("dias_desde_averia") if "dias_desde_averia" in present else F.col("tbf_dias")
    df = df.withColumn("tbf_dias", days.cast("double"))
    hours = F.col("horas_desde_averia") if "horas_desde_averia" in present else days * 8
    return df.withColumn("tbf_horas", hours.cast("double"))


def machine_type(key: str = "codigo") -> Column:
    return F.substring_index(F.col(key), "-", 1)


def type_factors(df: DataFrame, key: str = "equipo") -> DataFrame:
    """Join the nine machine types' reference factors; unknown types get the default type's."""
    spark = df.sparkSession
    dim = spark.createDataFrame(
        [(k, *v) for k, v in TYPE_FACTORS.items()],
        "tipo string, temp_base double, vib_scale double, hours_avg double",
    )
    base = TYPE_FACTORS[DEFAULT_TYPE]
    names = ("temp_base", "vib_scale", "hours_avg")
    joined = df.withColumn("tipo", machine_type(key)).join(F.broadcast(dim), "tipo", "left")
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.lit(base[i])) for i, n in enumerate(names)}
    )


def stable_bucket(key: Column, buckets: int) -> Column:
    """A bucket that depends on the text alone: leading 32 bits of its md5."""
    return F.pmod(
        F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets).cast("bigint")
    )


def health_labels(telemetry: DataFrame, horizon_days: int = 365) -> DataFrame:
    """Degradation, failure probability and remaining life of a telemetry reading."""
    temp, vib = F.col("temperatura"), F.col("vibracion")
    day = F.col("dia_anio")
    degradation = F.lit(1) + day / F.lit(float(horizon_days)) * F.lit(0.3)
    load = vib * degradation + F.col("horas_operacion") * 0.1
    heat = F.greatest(F.lit(0.0), temp - 80) * 0.05
    return telemetry.withColumns(
        {
            "degradacion": degradation,
            "prob_falla_30d": F.least(F.lit(1.0), (load + heat) / 100),
            "rul_estimado": F.greatest(
                F.lit(10.0),
                F.lit(horizon_days) - day - vib * 10 - F.greatest(F.lit(0.0), temp - 85) * 2,
            ),
        }
    )


# ---------------------------------------------------------------- visit timeline


def visit_timeline(visits: DataFrame, as_of: str, cuts: Cuts = NO_CUTS) -> DataFrame:
    """One pass over the log per machine; Catalyst drops the columns a query does not use.

    Neighbours: ``tbf_dias``, ``anterior_in``, ``siguiente_in``. Last rows: ``tbf_med_60d``,
    ``tbf_std_60d`` (5 visits), ``mttr_med_90d`` (10), ``tbf_mean_3``, ``tbf_med_3``, ``mttr_mean_3`` (3). Whole
    machine: ``n_visitas``, ``primera_in``, ``ultima_in``, ``mttr_eq``; ``n_min5`` marks a
    machine's visits from the fifth on.
    """
    df = visits.withColumns(
        {"ciclo_horas": repair_hours(), "dias_desde_ultima_salida": days_since_exit(as_of)}
    )
    rows = with_neighbours(df, cuts, before=10, after=1)
    seq = machine_window(cuts, *_ORDER)

    def last(n: int):
        return seq.rowsBetween(-(n - 1), 0)

    placed = rows.withColumns(
        {
            "tbf_dias": elapsed_days(F.col("fecha_in"), F.lag("fecha_in").over(seq)),
            "anterior_in": F.lag("fecha_in").over(seq),
            "siguiente_in": F.lead("fecha_in").over(seq),
            "n_min5": F.row_number().over(seq) >= 5,
        }
    )
    measured = placed.withColumns(
        {
            "tbf_med_60d": F.percentile("tbf_dias", F.lit(0.5)).over(last(5)),
            "tbf_std_60d": F.coalesce(F.stddev_samp("tbf_dias").over(last(5)), F.lit(0.0)),
            "mttr_med_90d": F.percentile("ciclo_horas", F.lit(0.5)).over(last(10)),
            "tbf_mean_3": F.avg("tbf_dias").over(last(3)),
            "tbf_med_3": F.percentile("tbf_dias", F.lit(0.5)).over(last(3)),
            "mttr_mean_3": F.avg(_recorded_hours(df)).over(last(3)),
        }
    )
    return own_rows(_whole_machine(measured, df, cuts))


def _whole_machine(rows: DataFrame, df: DataFrame, cuts: Cuts) -> DataFrame:
    """Totals per machine: from the window's own partition, or aggregated apart for cut machines."""
    totals = {
        "n_visitas": F.count("*"),
        "primera_in": F.min("fecha_in"),
        "ultima_in": F.max("fecha_in"),
        "mttr_eq": F.avg("ciclo_horas"),
    }
    whole = machine_window(cuts)
    if not cuts:
        return rows.withColumns({name: agg.over(whole) for name, agg in totals.items()})
    listed = cuts.machines.select("codigo")
    hot = (
        df.join(listed, "codigo", "left_semi")
        .groupBy("codigo")
        .agg(*[agg.alias(f"_{name}") for name, agg in totals.items()])
    )
    joined = rows.join(hot, "codigo", "left")  # one row per cut machine
    # uncut machines have no lent rows, so their own partition is the machine
    return joined.withColumns(
        {name: F.coalesce(F.col(f"_{name}"), agg.over(whole)) for name, agg in totals.items()}
    ).drop(*[f"_{name}" for name in totals])


def _recorded_hours(df: DataFrame) -> Column:
    if "mttr_horas" not in df.columns:
        return F.col("ciclo_horas")
    return F.coalesce(F.col("mttr_horas"), elapsed_hours(F.col("fecha_out"), F.col("fecha_in")))


def label_next_visit(timeline: DataFrame, days: int = 30) -> DataFrame:
    """Days from leaving to the next entry and whether that is soon; open cycles are dropped."""
    left = F.coalesce(F.col("fecha_out"), F.col("fecha_in"))
    return (
        timeline.withColumn("days_to_next", elapsed_days(F.col("siguiente_in"), left))
        .filter(F.col("days_to_next").isNotNull())
        .withColumn("y", (F.col("days_to_next") <= days).cast("int"))
    )


# ---------------------------------------------------------------- counts over trailing days


@dataclass(frozen=True)
class Shift:
    """A sum that gains ``gain`` at a visit shifted by ``enter`` and loses ``loss`` at ``leave``.

    Shifts are in microseconds. Visits in ``(t-N, t]`` gain one at the visit and lose it N later.
    """

    enter: int
    leave: int
    gain: Column | int = 1
    loss: Column | int = 1


def trailing(days: int, closed: bool = False) -> Shift:
    return Shift(0, days * DAY_US + int(closed))


def following(days: int, closed: bool = True) -> Shift:
    """Visits after t, up to ``t+days`` (``closed``) or before it."""
    return Shift(-days * DAY_US + int(not closed), 0)


def counted(
    df: DataFrame, sums: dict[str, Shift], cuts: Cuts = NO_CUTS, within: Sequence[str] = ()
) -> DataFrame:
    """Add sums over days before or after every visit of its machine, ties included.

    Every visit is repeated once per distinct shift, without its payload, and one running sum per
    machine gives all counts together.
    """
    shifts = sorted({0} | {s.enter for s in sums.values()} | {s.leave for s in sums.values()})

    def weight(spec: Shift, shift: int) -> Column:
        value = F.lit(0)
        if shift == spec.enter:
            value = value + spec.gain
        if shift == spec.leave:
            value = value - spec.loss
        return value.cast("bigint")

    copies = [
        F.struct(
            F.lit(shift).cast("bigint").alias("shift"),
            *[weight(spec, shift).alias(name) for name, spec in sums.items()],
        )
        for shift in shifts
    ]
    keep = {"codigo", *within}
    real = F.col("_k.shift") == 0
    events = df.withColumn("_k", F.explode(F.array(*copies))).select(
        *[F.col(c) if c in keep else F.when(real, F.col(c)).alias(c) for c in df.columns],
        (micros(F.col("fecha_in")) + F.col("_k.shift")).alias("_at"),
        real.alias("_real"),
        *[F.col("_k")[name].alias(name) for name in sums],
    )
    return running_totals(events, cuts, list(sums), within=within)


def trailing_counts(
    df: DataFrame,
    windows: dict[str, int] | None = None,
    closed: bool = False,
    cuts: Cuts = NO_CUTS,
) -> DataFrame:
    """Visits of the machine in ``(t-N, t]``, or ``[t-N, t]`` with ``closed``."""
    windows = windows or {"ingresos_30d": 30, "ingresos_60d": 60, "ingresos_90d": 90}
    return counted(df, {name: trailing(n, closed) for name, n in windows.items()}, cuts)


def site_counts(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Closed 30-day count, defined for machines with at least three visits, else 1."""
    rows = trailing_counts(timeline, {"ingresos_30d": 30}, True, cuts)
    few = F.col("n_visitas") < 3
    return rows.withColumn("ingresos_30d", F.when(few, F.lit(1)).otherwise(F.col("ingresos_30d")))


def site_means(timeline: DataFrame) -> DataFrame:
    """Mean TBF and repair hours of the last three visits, global medians where undefined.

    The medians are taken before range validation, over all machines.
    """
    medians = global_medians(timeline, {"_t": F.col("tbf_dias"), "_m": _recorded_hours(timeline)})
    enough = F.col("n_visitas") >= 3
    return (
        timeline.crossJoin(F.broadcast(medians))  # one row
        .withColumn("tbf_mean_30d", F.coalesce(F.when(enough, F.col("tbf_mean_3")), F.col("_t")))
        .withColumn("mttr_mean_30d", F.coalesce(F.when(enough, F.col("mttr_mean_3")), F.col("_m")))
        .drop("_t", "_m")
    )


def system_counts(
    df: DataFrame,
    days: int = 60,
    windows: dict[str, int] | None = None,
    cuts: Cuts = NO_CUTS,
) -> DataFrame:
    """Same-system visits and distinct systems of the machine in the trailing days.

    A system is in force from a visit until ``days`` later. Overlapping stretches merge: one
    begins where no earlier same-system visit is near enough and ends where no later one is.
    Distinct systems are the running sum of beginnings minus endings, so the same pass can take
    further machine-wide trailing counts (``windows``).
    """
    near = {"sistema_count_60d": trailing(days), "_later": following(days, closed=False)}
    per_system = counted(df, near, cuts, within=["sistema_afectado"])
    # visits of one system at one instant: the first of them stands for the stretch
    peers = Window.partitionBy("codigo", "sistema_afectado", "fecha_in")
    first = F.col("visit_id") == F.min("visit_id").over(peers)
    alone = F.col("sistema_count_60d") == F.count("*").over(peers)
    marked = per_system.withColumns(
        {
            "_begins": (first & alone).cast("bigint"),
            "_ends": (first & (F.col("_later") == 0)).cast("bigint"),
        }
    ).drop("_later")
    sums = {
        "sistemas_unicos_60d": Shift(0, days * DAY_US, F.col("_begins"), F.col("_ends")),
        **{name: trailing(n) for name, n in (windows or {}).items()},
    }
    return counted(settled(marked, cuts), sums, cuts).drop("_begins", "_ends")


def visits_around(
    df: DataFrame, back_days: int, ahead_days: int, cuts: Cuts = NO_CUTS
) -> DataFrame:
    """Same-machine visits within ±N days of every visit, both ends included, itself too."""
    sums = {"_before": trailing(back_days, closed=True), "_after": following(ahead_days)}
    return (
        counted(df, sums, cuts)
        .withColumn("visitas_cercanas", F.col("_before") + F.col("_after"))
        .drop("_before", "_after")
    )


def period_labels(df: DataFrame, days: int = 30, cuts: Cuts = NO_CUTS) -> DataFrame:
    """``pre_falla`` where two or more visits follow within ``days``, else ``normal``."""
    label = F.when(F.col("_after") >= 2, "pre_falla").otherwise("normal")
    rows = counted(df, {"_after": following(days)}, cuts)
    return rows.withColumn("periodo", label).drop("_after")


# ---------------------------------------------------------------- statistics over trailing days


def anomaly_windows(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> DataFrame:
    """TBF, repair-hour and system statistics over the closed trailing 30 and 60 days.

    Order statistics need their frame's rows, so slices borrow the 60 days before them. Values
    that are null or not finite are left out; one value has no deviation (null).
    """
    rows = spread(timeline, cuts, back_days=60)
    keys = ("codigo", "_slice") if cuts else ("codigo",)
    # peers share a frame; the index only has to follow the order of the events
    index = F.count("tbf_dias").over(
        machine_window(cuts, *_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # the window brings each machine together and sorts it, so this sort costs nothing
    ordered = rows.withColumns({"_i": index, "_at": micros(F.col("fecha_in"))}).sortWithinPartitions(*keys, *_ORDER)
    schema = StructType([*ordered.schema.fields, *StructType.fromDDL(DDL).fields])
    kept = own_rows(ordered.mapInArrow(trailing_statistics(keys), schema))
    med30, med60 = F.col("tbf_med_30d"), F.col("tbf_med_60d_rango")
    m30, m90 = F.col("mttr_med_30d"), F.col("mttr_med_90d_rango")
    n30, n60 = F.col("ingresos_30d"), F.col("ingresos_60d")
    return kept.withColumns(
        {
            "ratio_actividad_30_60": n30 / F.greatest(F.lit(1), n60 - n30),
            "cambio_tbf": F.when(med60 > 0, med30 / med60).otherwise(F.lit(1.0)),
            "cambio_mttr": F.when(m90 > 0, m30 / m90).otherwise(F.lit(1.0)),
            "diversidad_sistemas_30d": F.lit(1) - F.col("sistema_dominante_30d") / F.greatest(F.lit(1), n30),
        }
    ).drop("_i", "_at")


# ---------------------------------------------------------------- last rows


def latest_per_machine(df: DataFrame, key: str = "codigo") -> DataFrame:
    """The last visit of every machine: an aggregation, so no machine is gathered or sorted."""
    names = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*names), F.struct("fecha_in", "visit_id")).alias("_l")
    return df.groupBy(key).agg(last).select(key, *[F.col("_l")[n].alias(n) for n in names])


def last_rows(df: DataFrame, n: int, key: str = "codigo") -> DataFrame:
    """The last n visits of every machine; the rank limit is applied before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.col("fecha_in").desc(), F.col("visit_id").desc())
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def recent_versus_usual(timeline: DataFrame, n: int = 3, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Median TBF of the last n visits beside the machine's own."""
    recent = last_rows(timeline.select("codigo", "fecha_in", "visit_id", "tbf_dias"), n)
    half = F.lit(0.5)
    return (
        recent.groupBy("codigo")
        .agg(F.percentile("tbf_dias", half).alias("tbf_reciente"))
        .join(
            machine_aggregates(timeline, [], {"tbf_historico": F.col("tbf_dias")}, cuts),
            "codigo",
        )
    )
