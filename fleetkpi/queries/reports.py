"""Profiles and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, features, profile
from ..operators import reports as rp
from ..operators.features import visit_timeline
from ..operators.timeline import find_cuts
from ..sources.adapters import AS_OF, telemetry_from_lineitem
from .base import Registry, big, cleaned, r, raw, sql, timeline, timeline_and_cuts, ts

QUERIES = Registry()


def telemetry(spark, sf_dir):
    return features.health_labels(telemetry_from_lineitem(spark, sf_dir))


@QUERIES.add(
    "A01",
    sql(
        """select count(*) as total_registros, cast(min(fecha_in) as date) as inicio,
             cast(max(fecha_in) as date) as fin, count(distinct codigo) as equipos_unicos,
             count(distinct sistema_afectado) as sistemas_afectados, count(distinct flota) as flotas,
             count(distinct clase) as clases, round(avg(tbf_dias), 6) as tbf_promedio,
             round(avg(ciclo_horas), 6) as mttr_promedio from tl""",
        "tl",
    ),
)
def data_summary(spark, sf_dir):
    s = profile.summary(timeline(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("tbf_promedio", "mttr_promedio")})


_RAW_COLUMNS = [
    "visit_id", "codigo", "fecha_in", "fecha_out", "sistema_afectado", "tipo_atencion", "mttr_horas", "flota", "clase", "tbf_dias"
]


@QUERIES.add(
    "A02",
    sql(
        """select 'duplicados' as tipo, '' as columna, cast(d as double) as valor from s
           union all select 'fechas_futuras', '', cast(f as double) from s
           union all select 'tbf_anomalos', '', cast(t as double) from s
           union all select 'puntaje', '', cast(greatest(0, 100 - 10 * ((d > 0)::int + (f > 0)::int + (t > 0)::int)) as double) from s"""
        + "".join(f" union all select 'faltante_pct', '{c}', round(m_{c} / n * 100, 6) from s where m_{c} > 0" for c in _RAW_COLUMNS),
        "visits",
        rv="""select *, floor((epoch_us(fecha_in) - epoch_us(lag(fecha_in) over (partition by codigo order by fecha_in, visit_id)))
                / 86400000000e0) as tbf_dias from visits""",
        s=f"""select count(*) as n, count(*) - count(distinct concat(codigo, cast(fecha_in as varchar))) as d,
                count(*) filter (fecha_in > timestamp '{AS_OF}') as f, count(*) filter (tbf_dias > 365 or tbf_dias < 0) as t, """
        + ", ".join(f"count(*) filter ({c} is null) as m_{c}" for c in _RAW_COLUMNS)
        + " from rv",
    ),
)
def quality_report(spark, sf_dir):
    """The log as it came, before anything is filtered, with all of its columns."""
    visits = raw(spark, sf_dir)
    rows = visit_timeline(visits, AS_OF, find_cuts(visits)).select(*_RAW_COLUMNS)
    return profile.quality_report(rows, AS_OF, _RAW_COLUMNS).select("tipo", "columna", r("valor"))


@QUERIES.add(
    "A03",
    sql(
        """select codigo, count(*) as total_ingresos, round(median(tbf_dias), 6) as tbf_promedio,
             round(median(mttr_horas), 6) as mttr_promedio,
             strftime(max(fecha_in), '%Y-%m-%d %H:%M:%S') as ultimo_ingreso,
             first(sp) as sistema_principal, first(tp) as tipo_atencion_principal
           from tl join (select codigo as c1, sistema_afectado as sp from
               (select codigo, sistema_afectado, row_number() over (partition by codigo
                  order by count(*) desc, sistema_afectado) as k from tl
                where sistema_afectado is not null group by 1, 2) where k = 1) on c1 = codigo
             join (select codigo as c2, tipo_atencion as tp from
               (select codigo, tipo_atencion, row_number() over (partition by codigo
                  order by count(*) desc, tipo_atencion) as k from tl
                where tipo_atencion is not null group by 1, 2) where k = 1) on c2 = codigo
           group by codigo""",
        "tl",
    ),
)
def machine_summary(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return rp.machine_summary(rows, cuts=cuts).select(
        "codigo", "total_ingresos", r("tbf_promedio"), r("mttr_promedio"), ts("ultimo_ingreso"),
        "sistema_principal", "tipo_atencion_principal",
    )


def _profiled(column: str, kind: str) -> str:
    return (
        f"select '{column}' as columna, '{kind}' as tipo, count({column}) as no_nulos, "
        f"count(*) - count({column}) as nulos, count(distinct {column}) as distintos, "
        f"cast(min({column}) as varchar) as ejemplo from visits"
    )


@QUERIES.add(
    "A04",
    sql(
        " union all ".join(
            _profiled(c, k)
            for c, k in (
                ("visit_id", "bigint"), ("codigo", "string"), ("fecha_in", "timestamp"),
                ("fecha_out", "timestamp"), ("sistema_afectado", "string"), ("tipo_atencion", "string"),
                ("mttr_horas", "double"), ("flota", "string"), ("clase", "string"),
            )
        ),
        "visits",
    ),
)
def column_profile(spark, sf_dir):
    return profile.profile_columns(raw(spark, sf_dir))


@QUERIES.add(
    "A05",
    sql(
        """select round((count(visit_id) + count(codigo) + count(fecha_in) + count(fecha_out)
               + count(sistema_afectado) + count(tipo_atencion) + count(mttr_horas) + count(flota)
               + count(clase)) / (count(*) * 9) * 100, 6) as completitud_pct,
             count(*) filter (whole) as filas_completas,
             round(count(*) filter (whole) / count(*) * 100, 6) as filas_completas_pct,
             round(count(codigo) / count(*) * 100, 6) as codigo_pct,
             round(count(sistema_afectado) / count(*) * 100, 6) as sistema_afectado_pct
           from (select *, visit_id is not null and codigo is not null and fecha_in is not null
               and fecha_out is not null and sistema_afectado is not null and tipo_atencion is not null
               and mttr_horas is not null and flota is not null and clase is not null as whole from visits)""",
        "visits",
    ),
)
def completeness(spark, sf_dir):
    out = profile.completeness(raw(spark, sf_dir), ["codigo", "sistema_afectado"])
    return out.select(*[c if c == "filas_completas" else r(c) for c in out.columns])


@QUERIES.add(
    "A06",
    sql(
        """select cast(min(fecha_in) as date) as desde, cast(max(fecha_in) as date) as hasta,
             floor((epoch_us(max(fecha_in)) - epoch_us(min(fecha_in))) / 86400000000e0) as dias,
             round(floor((epoch_us(max(fecha_in)) - epoch_us(min(fecha_in))) / 86400000000e0) / 36525e-2, 6)
               as anios, count(fecha_in) as validos from visits""",
        "visits",
    ),
)
def date_span(spark, sf_dir):
    return profile.date_span(raw(spark, sf_dir), "fecha_in").withColumn("anios", F.round("anios", 6))


@QUERIES.add(
    "A06",
    sql("select year(fecha_out) as anio, count(*) as registros from visits where fecha_out is not null group by 1", "visits"),
)
def rows_by_year(spark, sf_dir):
    return profile.rows_by_year(raw(spark, sf_dir), "fecha_out").select(big("anio"), "registros")


@QUERIES.add(
    "A07",
    sql(
        """select count(*) as equipos, round(avg(n), 6) as promedio, median(n) as mediana,
             min(n) as minimo, max(n) as maximo
           from (select codigo, count(*) as n from visits group by 1)""",
        "visits",
    ),
)
def visits_distribution(spark, sf_dir):
    return profile.visits_distribution(raw(spark, sf_dir)).withColumn("promedio", F.round("promedio", 6))


def _top(source: str, key: str, k: int, share: bool) -> str:
    pct = f", round(count(*) / (select count(*) from {source}) * 100, 6) as porcentaje" if share else ""
    return sql(
        f"""select {key}, count(*) as total{pct} from {source} where {key} is not null
            group by 1 order by total desc, {key} limit {k}""",
        source,
    )


@QUERIES.add("A07", _top("visits", "codigo", 10, False))
def top_machines_profile(spark, sf_dir):
    return rp.top_counts(raw(spark, sf_dir), "codigo", 10)


@QUERIES.add("A08", _top("visits", "sistema_afectado", 10, True))
def top_systems_profile(spark, sf_dir):
    top = rp.top_counts(raw(spark, sf_dir), "sistema_afectado", 10, share=True)
    return top.withColumn("porcentaje", F.round("porcentaje", 6))


@QUERIES.add(
    "A09",
    sql(
        """select count(distinct codigo) as equipos, count(*) as registros,
             round(count(*) / count(distinct codigo), 6) as registros_por_equipo,
             count(*) / count(distinct codigo) >= 10 as suficiente from visits""",
        "visits",
    ),
)
def enough_history(spark, sf_dir):
    return profile.enough_history(raw(spark, sf_dir)).withColumn(
        "registros_por_equipo", F.round("registros_por_equipo", 6)
    )


@QUERIES.add(
    "A10",
    sql(
        """select count(*) as total_registros, 9 as columnas_total, 'codigo' as codigo_column,
             (select count(distinct codigo) from visits where contains(codigo, '-') and length(codigo) >= 5)
               as equipos_unicos,
             (select string_agg(codigo, ', ' order by codigo) from (select distinct codigo from visits
                where contains(codigo, '-') and length(codigo) >= 5 order by codigo limit 10)) as primeros
           from visits""",
        "visits",
    ),
)
def quick_stats(spark, sf_dir):
    log = raw(spark, sf_dir)
    # the name test finds ``visit_id`` first, which holds no machine codes
    return profile.quick_stats(log, "codigo")


_MONTH = "strftime(fecha_in, '%Y-%m')"


@QUERIES.add("A11", sql(f"select {_MONTH} as mes, count(*) as ingresos from clean group by 1", "clean"))
def monthly_visits(spark, sf_dir):
    return rp.monthly(cleaned(spark, sf_dir))


@QUERIES.add(
    "W19",
    sql(
        """select mes, n as ingresos, round(case when count(*) over f = 3 and (select count(*) from x) > 3
             then avg(n) over f end, 6) as tendencia_3m
           from x window f as (order by mes rows between 2 preceding and current row)""",
        "clean",
        x=f"select {_MONTH} as mes, count(*) as n from clean group by 1",
    ),
)
def monthly_trend(spark, sf_dir):
    return rp.monthly_trend(cleaned(spark, sf_dir)).withColumn("tendencia_3m", F.round("tendencia_3m", 6))


@QUERIES.add("A12", _top("clean", "codigo", 15, False))
def top_machines(spark, sf_dir):
    return rp.top_counts(cleaned(spark, sf_dir), "codigo", 15)


@QUERIES.add("A13", _top("clean", "sistema_afectado", 10, True))
def top_systems(spark, sf_dir):
    top = rp.top_counts(cleaned(spark, sf_dir), "sistema_afectado", 10, share=True)
    return top.withColumn("porcentaje", F.round("porcentaje", 6))


_TBF = "select * from tl where tbf_dias > 0 and tbf_dias < 365"
_MTTR = "select * from tl where ciclo_horas > 0 and ciclo_horas < 200"


def _histogram(column: str, source: str, high: int, bins: int) -> str:
    return sql(
        f"""select cast(floor({column} / ({high} / {bins}e0)) + 1 as int) as bin, count(*) as filas,
              round(min(floor({column} / ({high} / {bins}e0))) * ({high} / {bins}e0), 6) as desde,
              round((min(floor({column} / ({high} / {bins}e0))) + 1) * ({high} / {bins}e0), 6) as hasta
            from x group by 1""",
        "tl",
        x=source,
    )


def _bins(df):
    return df.withColumns({c: F.round(c, 6) for c in ("desde", "hasta")})


@QUERIES.add("A14", _histogram("tbf_dias", _TBF, 365, 30))
def tbf_histogram(spark, sf_dir):
    return _bins(rp.histogram(clean.chart_tbf(timeline(spark, sf_dir)), "tbf_dias", 0, 365, 30))


def _top_means(key: str, measure: str, source: str) -> str:
    return sql(
        f"""select {key}, round(avg({measure}), 6) as promedio from x group by 1
            order by promedio desc, {key} limit 10""",
        "tl",
        x=source,
    )


@QUERIES.add("A15", _top_means("codigo", "tbf_dias", _TBF))
def top_tbf_machines(spark, sf_dir):
    rows = rp.top_means(clean.chart_tbf(timeline(spark, sf_dir)), "codigo", "tbf_dias", 10)
    return rows.withColumn("promedio", F.round("promedio", 6))


@QUERIES.add("A16", sql(f"select {_MONTH} as mes, round(avg(tbf_dias), 6) as promedio from x group by 1", "tl", x=_TBF))
def monthly_tbf(spark, sf_dir):
    rows = rp.monthly_mean(clean.chart_tbf(timeline(spark, sf_dir)), "tbf_dias")
    return rows.withColumn("promedio", F.round("promedio", 6))


@QUERIES.add(
    "A17",
    sql(
        """select clase, min(tbf_dias) as minimo, quantile_cont(tbf_dias, 25e-2) as q1,
             median(tbf_dias) as mediana, quantile_cont(tbf_dias, 75e-2) as q3, max(tbf_dias) as maximo
           from x group by 1 order by clase limit 5""",
        "tl",
        x=_TBF,
    ),
)
def tbf_five_numbers(spark, sf_dir):
    return rp.five_number(clean.chart_tbf(timeline(spark, sf_dir)), "clase", "tbf_dias", 5)


@QUERIES.add(
    "A18",
    sql(
        "select w as orden, d as dia_semana, "
        + ", ".join(f"count(*) filter (hour(fecha_in) = {h}) as h{h:02d}" for h in range(24))
        + """ from (values (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
               (5, 'Saturday'), (6, 'Sunday')) v(w, d) left join clean on isodow(fecha_in) - 1 = w
             group by 1, 2""",
        "clean",
    ),
)
def activity_heatmap(spark, sf_dir):
    return rp.heatmap(cleaned(spark, sf_dir))


@QUERIES.add("A19", _histogram("ciclo_horas", _MTTR, 200, 25))
def repair_histogram(spark, sf_dir):
    return _bins(rp.histogram(clean.chart_mttr(timeline(spark, sf_dir)), "ciclo_horas", 0, 200, 25))


@QUERIES.add("A20", _top_means("sistema_afectado", "ciclo_horas", _MTTR))
def repair_hours_by_system(spark, sf_dir):
    rows = rp.top_means(clean.chart_mttr(timeline(spark, sf_dir)), "sistema_afectado", "ciclo_horas", 10)
    return rows.withColumn("promedio", F.round("promedio", 6))


@QUERIES.add("A21", sql(f"select {_MONTH} as mes, round(avg(ciclo_horas), 6) as promedio from x group by 1", "tl", x=_MTTR))
def monthly_repair_hours(spark, sf_dir):
    rows = rp.monthly_mean(clean.chart_mttr(timeline(spark, sf_dir)), "ciclo_horas")
    return rows.withColumn("promedio", F.round("promedio", 6))


@QUERIES.add("A21", sql("select codigo, tbf_dias, ciclo_horas from x where tbf_dias is not null", "tl", x=_MTTR))
def repair_tbf_pairs(spark, sf_dir):
    return rp.mttr_tbf_pairs(clean.chart_mttr(timeline(spark, sf_dir)))


@QUERIES.add(
    "A22 C10",
    sql(
        """select equipo, round(prob_falla_pct, 6) as prob_falla_pct, round(temperatura, 6) as temperatura,
             round(vibracion, 6) as vibracion, round(horas_operacion, 6) as horas_operacion,
             case when prob_falla_pct > 70 then 'CRÍTICO' when prob_falla_pct > 50 then 'ALTO'
                  else 'MODERADO' end as estado,
             round((select avg(prob_falla_pct) from x), 6) as promedio_riesgo,
             (select count(*) from x) as total_equipos
           from x order by prob_falla_pct desc, equipo limit 5""",
        "telemetry",
        x="""select equipo, round(avg(prob_falla_30d) * 100, 6) as prob_falla_pct, avg(temperatura) as temperatura,
               avg(vibracion) as vibracion, avg(horas_operacion) as horas_operacion
             from telemetry where month(fecha) = 6 group by 1""",
    ),
)
def riskiest_machines(spark, sf_dir):
    rows = rp.telemetry_top(telemetry(spark, sf_dir), 5, 6)
    names = ("prob_falla_pct", "temperatura", "vibracion", "horas_operacion", "promedio_riesgo")
    return rows.withColumns({c: F.round(c, 6) for c in names})


@QUERIES.add(
    "A23",
    sql(
        """select dia_anio, round(avg(temperatura), 6) as temperatura, round(avg(vibracion), 6) as vibracion,
             round(avg(horas_operacion), 6) as horas_operacion, round(avg(ciclos_trabajo), 6) as ciclos_trabajo,
             round(avg(prob_falla_30d), 6) as prob_falla_30d from telemetry group by 1""",
        "telemetry",
    ),
)
def day_of_year_means(spark, sf_dir):
    rows = rp.day_of_year_means(telemetry(spark, sf_dir))
    return rows.select("dia_anio", *[r(c) for c in rows.columns[1:]])


@QUERIES.add(
    "A29",
    sql(
        """select codigo, count(*) as total from clean group by 1 having count(*) >= 5
           order by total desc, codigo limit 10""",
        "clean",
    ),
)
def machines_with_history(spark, sf_dir):
    return rp.busy_enough(cleaned(spark, sf_dir), 5, 10)


@QUERIES.add(
    "A30",
    sql(
        """select codigo, round(avg(ciclo_horas), 6) as uso_promedio, round(stddev_samp(ciclo_horas), 6) as desviacion,
             round(stddev_samp(ciclo_horas) / avg(ciclo_horas), 6) as coef_variacion from tl group by 1""",
        "tl",
    ),
)
def usage_variability(spark, sf_dir):
    rows = rp.usage_variability(timeline(spark, sf_dir))
    return rows.select("codigo", r("uso_promedio"), r("desviacion"), r("coef_variacion"))
