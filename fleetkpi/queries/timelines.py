"""Derived columns and machine windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features
from ..plans.forecast import daily_hours, machine_days
from ..sources.adapters import AS_OF, telemetry_from_lineitem
from .base import Registry, big, cleaned, cleaned_and_cuts, r, sql, timeline, timeline_and_cuts, ts

QUERIES = Registry()

_TS = "'%Y-%m-%d %H:%M:%S'"


@QUERIES.add("D01", sql("select visit_id, round(ciclo_horas, 6) as ciclo_horas from tl", "tl"))
def workshop_hours(spark, sf_dir):
    return cleaned(spark, sf_dir).select("visit_id", F.round(features.repair_hours(), 6).alias("ciclo_horas"))


@QUERIES.add(
    "D02 D03",
    sql(
        """select visit_id,
             floor((epoch_us(fecha_out) - epoch_us(fecha_in)) / 86400000000e0) as duracion_taller_dias,
             round((epoch_us(fecha_out) - epoch_us(fecha_in)) / 3600000000e0, 6) as duracion_taller_horas,
             round(coalesce(mttr_horas, (epoch_us(fecha_out) - epoch_us(fecha_in)) / 3600000000e0), 6)
               as mttr_horas
           from clean""",
        "clean",
    ),
)
def stay_and_repair_hours(spark, sf_dir):
    return features.stay_measures(cleaned(spark, sf_dir)).select(
        "visit_id", "duracion_taller_dias", r("duracion_taller_horas"), r("mttr_horas")
    )


@QUERIES.add("D04", sql("select visit_id, codigo, tbf_dias from tl", "tl"))
def time_between_failures(spark, sf_dir):
    return timeline(spark, sf_dir).select("visit_id", "codigo", "tbf_dias")


@QUERIES.add(
    "D05",
    sql(
        """select visit_id, tbf_dias, tbf_dias * 8 as tbf_horas from tl""",
        "tl",
    ),
)
def recorded_tbf(spark, sf_dir):
    """No counters in this log: days from the entries, hours at eight a day."""
    return features.recorded_tbf(timeline(spark, sf_dir)).select("visit_id", "tbf_dias", "tbf_horas")


@QUERIES.add(
    "D05",
    sql(
        """select visit_id, cast(1 + visit_id % 40 as double) as tbf_dias,
             cast((1 + visit_id % 40) * 24 as double) as tbf_horas from clean""",
        "clean",
    ),
)
def recorded_tbf_counters(spark, sf_dir):
    counters = {
        "dias_desde_averia": 1 + F.col("visit_id") % 40,
        "horas_desde_averia": (1 + F.col("visit_id") % 40) * 24,
    }
    return features.recorded_tbf(cleaned(spark, sf_dir).withColumns(counters)).select(
        "visit_id", "tbf_dias", "tbf_horas"
    )


@QUERIES.add("D06", sql("select visit_id, dias_desde_ultima_salida from tl", "tl"))
def days_since_exit(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "visit_id", features.days_since_exit(AS_OF).alias("dias_desde_ultima_salida")
    )


@QUERIES.add(
    "D07",
    sql(
        """select visit_id, month(fecha_in) as mes, isodow(fecha_in) - 1 as dia_semana,
             hour(fecha_in) as hora_ingreso, case when isodow(fecha_in) >= 6 then 1 else 0 end as es_fin_semana
           from clean""",
        "clean",
    ),
)
def calendar_parts(spark, sf_dir):
    return features.calendar_parts(cleaned(spark, sf_dir)).select(
        "visit_id", big("mes"), big("dia_semana"), big("hora_ingreso"), "es_fin_semana"
    )


@QUERIES.add(
    "D08",
    sql(
        """select visit_id, round(case when tbf_med_60d > 0 then tbf_dias / tbf_med_60d else 1e0 end, 6)
             as tbf_ratio from wf""",
        "wf",
    ),
)
def tbf_ratio(spark, sf_dir):
    ratio = features.tbf_ratio(F.col("tbf_dias"), F.col("tbf_med_60d"))
    return timeline(spark, sf_dir).select("visit_id", F.round(ratio, 6).alias("tbf_ratio"))


_CLOSED = """
  select *, floor((epoch_us(siguiente_in) - epoch_us(coalesce(fecha_out, fecha_in))) / 86400000000e0)
    as days_to_next from {0} where siguiente_in is not null"""


@QUERIES.add(
    "D09",
    sql(
        """select visit_id, codigo, days_to_next, case when days_to_next <= 30 then 1 else 0 end as y
           from c""",
        "tl",
        c=_CLOSED.format("tl"),
    ),
)
def next_visit_label(spark, sf_dir):
    return features.label_next_visit(timeline(spark, sf_dir)).select("visit_id", "codigo", "days_to_next", "y")


@QUERIES.add("D11", sql("select equipo, split_part(equipo, '-', 1) as tipo, count(*) as lecturas from tb group by 1, 2", "tb"))
def machine_types(spark, sf_dir):
    rows = telemetry_from_lineitem(spark, sf_dir).groupBy("equipo").agg(F.count("*").alias("lecturas"))
    return rows.withColumn("tipo", features.machine_type("equipo"))


@QUERIES.add(
    "D12",
    sql(
        """select equipo, coalesce(f.t, 70e0) as temp_base, coalesce(f.v, 2e0) as vib_scale,
             coalesce(f.h, 12e0) as hours_avg, count(*) as lecturas
           from tb left join (values ('VD', 70e0, 2e0, 12e0), ('CG', 80e0, 3e0, 10e0),
             ('EX', 85e0, 4e0, 14e0), ('CV', 75e0, 25e-1, 8e0), ('NE', 65e0, 15e-1, 6e0),
             ('RE', 70e0, 2e0, 10e0), ('AH', 75e0, 28e-1, 12e0), ('PE', 80e0, 32e-1, 10e0),
             ('TI', 90e0, 18e-1, 16e0)) f(k, t, v, h) on split_part(equipo, '-', 1) = f.k
           group by all""",
        "tb",
    ),
)
def type_factors(spark, sf_dir):
    rows = features.type_factors(telemetry_from_lineitem(spark, sf_dir))
    return rows.groupBy("equipo", "temp_base", "vib_scale", "hours_avg").agg(F.count("*").alias("lecturas"))


@QUERIES.add(
    "D13",
    sql(
        """select codigo, cast(('0x' || substr(md5(codigo), 1, 8)) as bigint) % 1000 as cubeta, count(*) as n
           from clean group by 1, 2""",
        "clean",
    ),
)
def stable_buckets(spark, sf_dir):
    return (
        cleaned(spark, sf_dir)
        .groupBy("codigo")
        .agg(F.count("*").alias("n"))
        .withColumn("cubeta", features.stable_bucket(F.col("codigo"), 1000))
    )


@QUERIES.add(
    "D14",
    sql(
        """select equipo, dia_anio, round(degradacion, 6) as degradacion,
             round(prob_falla_30d, 6) as prob_falla_30d, round(rul_estimado, 6) as rul_estimado
           from telemetry""",
        "telemetry",
    ),
)
def health_labels(spark, sf_dir):
    return features.health_labels(telemetry_from_lineitem(spark, sf_dir)).select(
        "equipo", "dia_anio", r("degradacion"), r("prob_falla_30d"), r("rul_estimado")
    )


# ---------------------------------------------------------------- windows


@QUERIES.add("W01", sql("select visit_id, ingresos_30d, ingresos_60d, ingresos_90d from wf", "wf"))
def trailing_visits(spark, sf_dir):
    visits, cuts = cleaned_and_cuts(spark, sf_dir)
    rows = features.trailing_counts(visits, cuts=cuts)
    return rows.select("visit_id", "ingresos_30d", "ingresos_60d", "ingresos_90d")


_CLOSED30 = """(partition by codigo order by epoch_us(fecha_in)
                range between 2592000000000 preceding and current row)"""
_CLOSED60 = """(partition by codigo order by epoch_us(fecha_in)
                range between 5184000000000 preceding and current row)"""


@QUERIES.add(
    "W02",
    sql(
        f"""select visit_id, case when n_visitas < 3 then 1 else count(*) over {_CLOSED30} end as ingresos_30d
            from tl""",
        "tl",
    ),
)
def trailing_visits_closed(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return features.site_counts(rows, cuts).select("visit_id", "ingresos_30d")


@QUERIES.add(
    "W03 W04",
    sql(
        "select visit_id, round(tbf_med_60d, 6) as tbf_med_60d, round(tbf_std_60d, 6) as tbf_std_60d from wf",
        "wf",
    ),
)
def tbf_last_five(spark, sf_dir):
    return timeline(spark, sf_dir).select("visit_id", r("tbf_med_60d"), r("tbf_std_60d"))


@QUERIES.add(
    "W05 W06",
    sql("select visit_id, round(mttr_med_90d, 6) as mttr_med_90d, round(mttr_eq, 6) as mttr_eq from wf", "wf"),
)
def repair_hours_last_ten(spark, sf_dir):
    return timeline(spark, sf_dir).select("visit_id", r("mttr_med_90d"), r("mttr_eq"))


@QUERIES.add(
    "W07",
    sql(
        """select visit_id,
             round(coalesce(case when n_visitas >= 3 then avg(tbf_dias) over
               (partition by codigo order by fecha_in, visit_id rows between 2 preceding and current row) end, mt), 6)
               as tbf_mean_30d,
             round(coalesce(case when n_visitas >= 3 then avg(h) over
               (partition by codigo order by fecha_in, visit_id rows between 2 preceding and current row) end, mh), 6)
               as mttr_mean_30d
           from x cross join (select median(tbf_dias) as mt, median(h) as mh from x)""",
        "tl",
        x="""select *, coalesce(mttr_horas, (epoch_us(fecha_out) - epoch_us(fecha_in)) / 3600000000e0) as h
             from tl""",
    ),
)
def means_last_three(spark, sf_dir):
    rows = features.site_means(timeline(spark, sf_dir))
    return rows.select("visit_id", r("tbf_mean_30d"), r("mttr_mean_30d"))


@QUERIES.add("W08 W09", sql("select visit_id, sistema_count_60d, sistemas_unicos_60d from wf", "wf"))
def system_recurrence(spark, sf_dir):
    visits, cuts = cleaned_and_cuts(spark, sf_dir)
    rows = features.system_counts(visits, cuts=cuts)
    return rows.select("visit_id", "sistema_count_60d", "sistemas_unicos_60d")


@QUERIES.add(
    "W10",
    sql(
        f"""select visit_id, round(coalesce(quantile_cont(tbf_dias, 5e-1) over w, 0e0), 6) as tbf_med_30d,
              round(case when count(tbf_dias) over w = 0 then 0e0 else stddev_samp(tbf_dias) over w end, 6)
                as tbf_std_30d,
              coalesce(min(tbf_dias) over w, 0e0) as tbf_min_30d,
              coalesce(max(tbf_dias) over w, 0e0) as tbf_max_30d
            from tl window w as {_CLOSED30}""",
        "tl",
    ),
)
def tbf_month_statistics(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return features.anomaly_windows(rows, cuts).select(
        "visit_id", r("tbf_med_30d"), r("tbf_std_30d"), "tbf_min_30d", "tbf_max_30d"
    )


_INDEXED = """select *, count(tbf_dias) over (partition by codigo order by fecha_in, visit_id
                rows unbounded preceding) as i from tl"""


@QUERIES.add(
    "W11",
    sql(
        f"""select visit_id, round(coalesce(quantile_cont(tbf_dias, 5e-1) over w, 0e0), 6) as tbf_med_60d,
              round(case when count(tbf_dias) over w >= 3 then coalesce(regr_slope(tbf_dias, i) over w, 0e0)
                    else 0e0 end, 6) as tbf_trend
            from x window w as {_CLOSED60}""",
        "tl",
        x=_INDEXED,
    ),
)
def tbf_trend(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return features.anomaly_windows(rows, cuts).select(
        "visit_id", F.round("tbf_med_60d_rango", 6).alias("tbf_med_60d"), r("tbf_trend")
    )


_SYSTEM_PAIRS = """
  select visit_id, count(*) filter (near) as n30, max(per30) as dom, count(distinct s) filter (per30 > 0) as u30,
    count(distinct s) as u60, sum(per30) as total30
  from (select a.visit_id, b.sistema_afectado as s, true as near,
          count(*) filter (b.fecha_in >= a.fecha_in - interval '30' day) as per30
        from tl a join tl b on a.codigo = b.codigo
          and b.fecha_in between a.fecha_in - interval '60' day and a.fecha_in
        group by 1, 2) group by 1"""


@QUERIES.add(
    "W12",
    sql(
        """select visit_id, u30 as sistemas_unicos_30d, u60 as sistemas_unicos_60d,
             dom as sistema_dominante_30d, round(1 - dom / greatest(1, total30), 6) as diversidad_sistemas_30d
           from s""",
        "tl",
        s=_SYSTEM_PAIRS,
    ),
)
def system_mix(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return features.anomaly_windows(rows, cuts).select(
        "visit_id", big("sistemas_unicos_30d"), big("sistemas_unicos_60d"), big("sistema_dominante_30d"),
        r("diversidad_sistemas_30d"),
    )


@QUERIES.add(
    "W13",
    sql(
        f"""select visit_id, round(quantile_cont(ciclo_horas, 5e-1) over w, 6) as mttr_med_30d,
              round(stddev_samp(ciclo_horas) over w, 6) as mttr_std_30d,
              max(ciclo_horas) over w as mttr_max_30d,
              round(quantile_cont(ciclo_horas, 5e-1) over v, 6) as mttr_med_90d
            from tl window w as {_CLOSED30}, v as {_CLOSED60}""",
        "tl",
    ),
)
def repair_month_statistics(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return features.anomaly_windows(rows, cuts).select(
        "visit_id", r("mttr_med_30d"), r("mttr_std_30d"), "mttr_max_30d",
        F.round("mttr_med_90d_rango", 6).alias("mttr_med_90d"),
    )


@QUERIES.add(
    "W14",
    sql(
        """select visit_id, round(n30 / greatest(1, n60 - n30), 6) as ratio_actividad_30_60,
             round(case when t60 > 0 then t30 / t60 else 1e0 end, 6) as cambio_tbf,
             round(case when m60 > 0 then m30 / m60 else 1e0 end, 6) as cambio_mttr
           from x""",
        "tl",
        x=f"""select visit_id, count(*) over w as n30, count(*) over v as n60,
                coalesce(quantile_cont(tbf_dias, 5e-1) over w, 0e0) as t30,
                coalesce(quantile_cont(tbf_dias, 5e-1) over v, 0e0) as t60,
                quantile_cont(ciclo_horas, 5e-1) over w as m30,
                quantile_cont(ciclo_horas, 5e-1) over v as m60
              from tl window w as {_CLOSED30}, v as {_CLOSED60}""",
    ),
)
def change_ratios(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return features.anomaly_windows(rows, cuts).select(
        "visit_id", r("ratio_actividad_30_60"), r("cambio_tbf"), r("cambio_mttr")
    )


@QUERIES.add("W15", sql("select visit_id, codigo from tl where rn >= 5", "tl"))
def fifth_visit_on(spark, sf_dir):
    return timeline(spark, sf_dir).filter("n_min5").select("visit_id", "codigo")


@QUERIES.add(
    "W16",
    sql(
        """select visit_id, case when count(*) over (partition by codigo order by epoch_us(fecha_in)
             range between 1 following and 2592000000000 following) >= 2
             then 'pre_falla' else 'normal' end as periodo from tl""",
        "tl",
    ),
)
def period_labels(spark, sf_dir):
    visits, cuts = cleaned_and_cuts(spark, sf_dir)
    return features.period_labels(visits, cuts=cuts).select("visit_id", "periodo")


@QUERIES.add(
    "W17",
    sql(
        f"""select codigo, visit_id, strftime(fecha_in, {_TS}) as fecha_in, clase, flota, tbf_dias from last""",
        "last",
    ),
)
def latest_visit(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("codigo", "visit_id", "fecha_in", "clase", "flota", "tbf_dias")
    return features.latest_per_machine(rows).select("codigo", "visit_id", ts("fecha_in"), "clase", "flota", "tbf_dias")


@QUERIES.add(
    "W18",
    sql(
        """select codigo, median(tbf_dias) filter (rn > n_visitas - 3) as tbf_reciente,
             median(tbf_dias) as tbf_historico from tl group by codigo""",
        "tl",
    ),
)
def recent_versus_usual(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return features.recent_versus_usual(rows, cuts=cuts)


@QUERIES.add(
    "J06",
    sql(
        """select a.visit_id, count(*) as visitas_cercanas from clean a join clean b on a.codigo = b.codigo
             and b.fecha_in between a.fecha_in - interval '30' day and a.fecha_in + interval '30' day
           group by 1""",
        "clean",
    ),
)
def visits_around(spark, sf_dir):
    visits, cuts = cleaned_and_cuts(spark, sf_dir)
    rows = features.visits_around(visits, 30, 30, cuts)
    return rows.select("visit_id", "visitas_cercanas")


_DAILY = """
  select s.codigo, s.ds, coalesce(d.h, 0e0) as y
  from (select codigo, cast(unnest(generate_series(lo, hi, interval '1' day)) as date) as ds
        from (select codigo, cast(min(fecha_in) as date) as lo, cast(max(fecha_in) as date) as hi
              from tl group by codigo having count(*) >= 3)) s
  left join (select codigo, cast(fecha_in as date) as ds, sum(ciclo_horas) as h from tl group by 1, 2) d
    on d.codigo = s.codigo and d.ds = s.ds"""


@QUERIES.add(
    "W20 M13",
    sql(
        """select codigo, ds, round(avg(y) over (partition by codigo order by ds
             rows between 2 preceding and current row), 6) as suave from daily""",
        "tl",
        daily=_DAILY,
    ),
)
def daily_usage_smoothed(spark, sf_dir):
    frame = Window.partitionBy("codigo").orderBy("ds").rowsBetween(-2, 0)
    return daily_hours(machine_days(timeline(spark, sf_dir))).select(
        "codigo", "ds", F.round(F.avg("y").over(frame), 6).alias("suave")
    )


