"""Indicator models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from ..operators.forest import decision, score_forest
from ..operators.machine_stats import fleet_stats, machine_stats, shared_stats
from ..plans import anomaly, forecast, fr30, rul, survival
from ..plans import telemetry as tm
from ..sources.adapters import AS_OF, TELEMETRY_AS_OF, telemetry_from_lineitem
from ..sources.exports import load_model, save_model
from ..storage import materialise, scratch_folder
from .base import Registry, big, r, sql, timeline, timeline_and_cuts
from .reports import telemetry
from .timelines import _CLOSED, _CLOSED30, _CLOSED60, _DAILY, _INDEXED, _SYSTEM_PAIRS

QUERIES = Registry()

# ---------------------------------------------------------------- return within 30 days


@QUERIES.add(
    "M06 M05",
    sql("select codigo, risk_30d, banda, ingresos_30d, round(tbf_promedio, 6) as tbf_promedio from fr30", "fr30"),
)
def return_risk_rules(spark, sf_dir):
    return fr30.rule_risk(machine_stats(timeline(spark, sf_dir))).withColumn("tbf_promedio", F.round("tbf_promedio", 6))


@QUERIES.add(
    "M01 D07 D08 D10",
    sql(
        """select visit_id, codigo, y, t as tbf_dias, dias_desde_ultima_salida, ingresos_30d, ingresos_60d,
             ingresos_90d, sistema_count_60d, round(mttr_eq, 6) as mttr_eq, flota, clase,
             month(fecha_in) as mes, isodow(fecha_in) - 1 as dia_semana, hour(fecha_in) as hora_ingreso,
             round(m, 6) as tbf_med_60d, round(tbf_std_60d, 6) as tbf_std_60d,
             round(case when m > 0 then t / m else 1e0 end, 6) as tbf_ratio
           from (select *, case when days_to_next <= 30 then 1 else 0 end as y, coalesce(tbf_dias, 0e0) as t,
                   coalesce(tbf_med_60d, coalesce(tbf_dias, 0e0)) as m from c)""",
        "wf",
        c=_CLOSED.format("wf"),
    ),
)
def return_training_set(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return fr30.training_set(rows, cuts).select(
        "visit_id", "codigo", "y", "tbf_dias", "dias_desde_ultima_salida", "ingresos_30d", "ingresos_60d",
        "ingresos_90d", "sistema_count_60d", r("mttr_eq"), "flota", "clase", big("mes"), big("dia_semana"),
        big("hora_ingreso"), r("tbf_med_60d"), r("tbf_std_60d"), r("tbf_ratio"),
    )


@QUERIES.add(
    "M04 D10 W17",
    sql(
        """select codigo, t as tbf_dias, dias_desde_ultima_salida, ingresos_30d, ingresos_60d, ingresos_90d,
             sistema_count_60d, round(case when mttr_eq = 0 then 24e0 else mttr_eq end, 6) as mttr_eq,
             flota, clase, round(m, 6) as tbf_med_60d, round(tbf_std_60d, 6) as tbf_std_60d,
             round(case when m > 0 then t / m else 1e0 end, 6) as tbf_ratio
           from (select *, coalesce(tbf_dias, 0e0) as t, coalesce(tbf_med_60d, 0e0) as m from lastwf)""",
        "lastwf",
    ),
)
def machine_state(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return fr30.current_state(rows, cuts).select(
        "codigo", "tbf_dias", "dias_desde_ultima_salida", "ingresos_30d", "ingresos_60d", "ingresos_90d",
        "sistema_count_60d", r("mttr_eq"), "flota", "clase", r("tbf_med_60d"), r("tbf_std_60d"), r("tbf_ratio"),
    )


@QUERIES.add("M02 M03 M04 M05")
def return_risk_trained(spark, sf_dir):
    """Boosted trees with calibration; not expressible in SQL."""
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return fr30.risk(rows, cuts)


# ---------------------------------------------------------------- remaining life

_GAPS = """select codigo, cast(tbf_dias as bigint) as duration, clase, flota, anterior_in, fecha_in
           from tl where tbf_dias > 0 and tbf_dias < 1000"""


@QUERIES.add(
    "M07",
    sql(
        """select codigo, duration, 1 as event, clase, flota,
             strftime(anterior_in, '%Y-%m-%d %H:%M:%S') as fecha_inicio,
             strftime(fecha_in, '%Y-%m-%d %H:%M:%S') as fecha_evento from gaps""",
        "tl",
        gaps=_GAPS,
    ),
)
def survival_intervals(spark, sf_dir):
    stamp = "yyyy-MM-dd HH:mm:ss"
    return rul.intervals(timeline(spark, sf_dir)).withColumns(
        {c: F.date_format(c, stamp) for c in ("fecha_inicio", "fecha_evento")}
    )


# maximum likelihood by the same fixed point, as list arithmetic
_WEIBULL = {
    "gaps": _GAPS,
    "h": "select clase, duration, count(*) as n from gaps group by 1, 2",
    "g": """select clase, list(duration / top order by duration) as xs, list(cast(n as double) order by duration) as ns,
              sum(n) as total, any_value(top) as top, sum(n * duration) / sum(n) as media,
              sum(n * ln(duration / top)) / sum(n) as ml
            from (select *, max(duration) over (partition by clase) as top from h) group by clase
            having sum(n) >= 5 and count(*) > 1""",
    "w": """select clase, top, media, total, k,
              top * pow(list_sum(list_transform(range(1, len(xs) + 1), lambda i: ns[i] * pow(xs[i], k))) / total, 1e0 / k)
                as lam
            from (select *, list_reduce(list_transform(range(200), lambda z: 1e0),
                    lambda k, z: (k + 1e0 / (
                      list_sum(list_transform(range(1, len(xs) + 1), lambda i: ns[i] * pow(xs[i], k) * ln(xs[i])))
                      / list_sum(list_transform(range(1, len(xs) + 1), lambda i: ns[i] * pow(xs[i], k))) - ml)) / 2,
                    1e0) as k from g)""",
}


@QUERIES.add(
    "M08",
    sql(
        """select clase, round(lam, 6) as lambda, round(k, 6) as k, cast(total as bigint) as n_observaciones,
             round(media, 6) as duracion_media from w""",
        "tl",
        **_WEIBULL,
    ),
)
def weibull_parameters(spark, sf_dir):
    params = rul.fit_weibull(rul.intervals(timeline(spark, sf_dir)))
    return params.select("clase", r("lambda"), r("k"), "n_observaciones", r("duracion_media"))


_CENSORED = {
    "gaps": _GAPS,
    "ci": f"""select clase, duration, 1 as e from gaps
              union all select clase, duration, 0 from (select clase, cast(least(1000,
                floor((epoch_us(timestamp '{AS_OF}') - epoch_us(fecha_in)) / 86400000000e0)) as bigint) as duration from last)
              where duration > 0""",
    "days": """select *, sum(d + c) over (partition by clase order by duration desc) as n
               from (select clase, duration, sum(e) as d, count(*) - sum(e) as c from ci group by 1, 2)""",
    "km": """select *, case when max(case when d = n then 1 else 0 end) over w = 1 then 0e0
                 else exp(sum(case when d < n then ln(1 - d / n) end) over w) end as s,
               sum(case when d < n then d / (n * (n - d)) end) over w as g
             from days window w as (partition by clase order by duration)""",
}


@QUERIES.add(
    "M07 M11",
    sql(
        """select clase, duration, cast(d as bigint) as eventos, cast(c as bigint) as abiertos, cast(n as bigint) as en_riesgo,
             round(s, 6) as supervivencia, round(s * sqrt(coalesce(g, 0)), 6) as error from km""",
        "last",
        **_CENSORED,
    ),
)
def survival_estimate(spark, sf_dir):
    """Product-limit estimate of each class, with the open intervals of all machines."""
    days = survival.life_table(survival.censored_intervals(timeline(spark, sf_dir), AS_OF))
    return survival.product_limit(days).select(
        "clase", "duration", "eventos", "abiertos", "en_riesgo", r("supervivencia"), r("error")
    )


@QUERIES.add(
    "M08 M11",
    sql(
        """select clase, round(lam, 6) as lambda, round(k, 6) as k, cast(eventos as bigint) as n_eventos,
             cast(abiertos as bigint) as n_abiertos, true as converge, round(1 - away, 6) as fit_quality, mediana_km,
             round(lam * pow(-ln(5e-1), 1 / k), 6) as rul50_d,
             concat_ws(' ', printf('%.4f', lam * pow(-ln(9e-1), 1 / k)), printf('%.4f', lam * pow(-ln(1e-1), 1 / k))) as confidence_interval
           from cw join (select clase, max(greatest(abs(s - m), abs(before - m))) as away,
                           min(case when s <= 5e-1 then duration end) as mediana_km
                         from (select km.clase, duration, s, exp(-pow(duration / lam, k)) as m,
                                 lag(s, 1, 1e0) over (partition by km.clase order by duration) as before
                               from km join cw on cw.clase = km.clase) group by 1) using (clase)""",
        "last",
        **_CENSORED,
        cg="""select clase, list(duration / top order by duration) as xs, list(cast(d + c as double) order by duration) as ns,
                any_value(top) as top, sum(d) as eventos, sum(c) as abiertos, sum(d * ln(duration / top)) / sum(d) as ml
              from (select *, max(duration) over (partition by clase) as top from days) group by clase
              having sum(d) >= 5 and count(*) filter (d > 0) > 1""",
        cw="""select clase, eventos, abiertos, k,
                top * pow(list_sum(list_transform(range(1, len(xs) + 1), lambda i: ns[i] * pow(xs[i], k))) / eventos, 1e0 / k) as lam
              from (select *, list_reduce(list_transform(range(300), lambda z: 1e0), lambda k, z: (k + 1e0 / (
                      list_sum(list_transform(range(1, len(xs) + 1), lambda i: ns[i] * pow(xs[i], k) * ln(xs[i])))
                      / list_sum(list_transform(range(1, len(xs) + 1), lambda i: ns[i] * pow(xs[i], k))) - ml)) / 2, 1e0) as k
                    from cg)""",
    ),
)
def survival_fit(spark, sf_dir):
    """Censored Weibull of each class, and how far it is from the product-limit estimate; the twin takes fixed-point steps."""
    days = survival.life_table(survival.censored_intervals(timeline(spark, sf_dir), AS_OF))
    found = survival.fit_quality(days, survival.fit_censored(days))
    ends = F.transform("confidence_interval", lambda x: F.format_string("%.4f", x))
    return found.select(
        "clase", r("lambda"), r("k"), "n_eventos", "n_abiertos", (F.col("residuo") < 1e-9).alias("converge"), r("fit_quality"),
        "mediana_km", r("rul50_d"), F.concat_ws(" ", ends).alias("confidence_interval"),
    )


def _life(q: str, factor: str) -> str:
    return (
        f"greatest(0e0, least(pow(pow(ta, k) - pow(lam, k) * ln({q}), 1e0 / k) - ta, lam * {factor}))"
    )


_WEIBULL_LIFE = f"""
  select codigo, clase, edad, lam, k, total, {_life('5e-1', '2e0')} as rul50_d, {_life('1e-1', '3e0')} as rul90_d
  from (select l.codigo, l.clase, w.lam, w.k, w.total,
          greatest(0e0, floor((epoch_us(timestamp '{AS_OF}') - epoch_us(l.fecha_in)) / 86400000000e0)) as edad,
          greatest(1e0, floor((epoch_us(timestamp '{AS_OF}') - epoch_us(l.fecha_in)) / 86400000000e0)) as ta
        from last l join w on w.clase = l.clase)"""


@QUERIES.add(
    "M09 J04",
    sql(
        """select codigo, round(rul50_d, 6) as rul50_d, round(rul90_d, 6) as rul90_d, edad as edad_actual_d, clase,
             clase as modelo_usado, round(lam, 6) as lambda, round(k, 6) as k,
             cast(total as bigint) as n_observaciones from life""",
        "last",
        **_WEIBULL,
        life=_WEIBULL_LIFE,
    ),
)
def remaining_life(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    latest = features.latest_per_machine(rows.select("codigo", "fecha_in", "visit_id", "clase"))
    life = rul.remaining_life(latest, rul.fit_weibull(rul.intervals(rows)), AS_OF)
    return life.select(
        "codigo", r("rul50_d"), r("rul90_d"), "edad_actual_d", "clase", "modelo_usado", r("lambda"), r("k"),
        "n_observaciones",
    )


@QUERIES.add(
    "M10",
    sql(
        """select codigo, round(rul50_d, 6) as rul50_d, round(rul90_d, 6) as rul90_d, edad_actual_d, clase,
             modelo_usado, tbf_base from rul""",
        "rul",
    ),
)
def remaining_life_rules(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    rows = rul.rule_rul(machine_stats(rows), fleet_stats(rows), AS_OF)
    return rows.withColumns({c: F.round(c, 6) for c in ("rul50_d", "rul90_d")})


@QUERIES.add(
    "M11",
    sql(
        """select clase, round(lam, 6) as lambda, round(k, 6) as k, dias,
             round(exp(-pow(dias / lam, k)), 6) as probabilidad,
             round(lam * pow(-ln(9e-1), 1 / k), 6) as rul_s90_d, round(lam * pow(-ln(5e-1), 1 / k), 6) as rul_s50_d,
             round(lam * pow(-ln(1e-1), 1 / k), 6) as rul_s10_d
           from w cross join (values (10e0), (30e0), (60e0)) d(dias)""",
        "tl",
        **_WEIBULL,
    ),
)
def survival_curves(spark, sf_dir):
    rows = rul.survival_curve(rul.fit_weibull(rul.intervals(timeline(spark, sf_dir))))
    return rows.select("clase", "dias", *[r(c) for c in rows.columns if c not in ("clase", "dias")])


@QUERIES.add(
    "M12",
    sql(
        """select codigo, round(rul50_d, 6) as rul50_d, round(rul90_d, 6) as rul90_d,
             greatest(1, cast(trunc(rul90_d * 7e-1) as bigint)) as ventana_optima_inicio,
             cast(trunc(rul50_d * 9e-1) as bigint) as ventana_optima_fin,
             case when rul90_d < 7 then 'ALTA' when rul90_d < 21 then 'MEDIA' else 'BAJA' end as urgencia,
             round(rul50_d * horas_por_dia, 6) as rul50_h, round(rul90_d * horas_por_dia, 6) as rul90_h
           from rul join forecast using (codigo)""",
        "rul",
        "forecast",
    ),
)
def maintenance_windows(spark, sf_dir):
    stats, fleet = shared_stats(timeline(spark, sf_dir))
    life = rul.rule_rul(stats, fleet, AS_OF).select("codigo", "rul50_d", "rul90_d")
    use = forecast.rule_forecast(stats, fleet).select("codigo", "horas_por_dia")
    out = rul.maintenance_window(life.join(use, "codigo"), F.col("horas_por_dia"))
    return out.select(
        "codigo", r("rul50_d"), r("rul90_d"), "ventana_optima_inicio", "ventana_optima_fin", "urgencia",
        r("rul50_h"), r("rul90_h"),
    )


# ---------------------------------------------------------------- usage

_SERIES = {
    "daily": _DAILY,
    "smooth": """select *, avg(y) over (partition by codigo order by ds rows between 2 preceding and current row) as s
                 from daily""",
    "capped": """select s.codigo, s.ds, least(s.s, q.q) as y from smooth s
                 join (select codigo, quantile_cont(s, 99e-2) as q from smooth group by 1) q on q.codigo = s.codigo""",
    "stats": """select codigo, count(*) as dias, avg(y) as media, stddev_samp(y) as desviacion, max(y) as maximo,
                  count(*) filter (y > 0) as dias_con_uso from capped group by 1
                having stddev_samp(y) > 1e-1 and count(*) >= 10""",
    "series": """select c.codigo, c.ds, c.y, l.clase, t.dias, t.media from capped c
                 join stats t on t.codigo = c.codigo join last l on l.codigo = c.codigo""",
}


def _fitted(key: str, source: str, min_days: int) -> str:
    return f"""
      select t.{key}, t.sl as pendiente, t.ic as intercepto, t.media, t.ultimo, t.dias,
        list(coalesce(e.ef, 0e0) order by e.w) as efectos
      from (select {key}, regr_slope(y, x) as sl, regr_intercept(y, x) as ic, avg(y) as media, max(ds) as ultimo,
              count(*) as dias
            from (select *, cast(epoch(ds) / 86400 as double) as x from {source}) group by 1
            having count(*) >= {min_days}) t
      cross join (select unnest(range(7)) as w) ww
      left join (select s.{key}, isodow(s.ds) - 1 as w,
                   avg(s.y - (m.ic + m.sl * epoch(s.ds) / 86400)) as ef
                 from {source} s join (select {key}, regr_slope(y, epoch(ds) / 86400) as sl,
                                         regr_intercept(y, epoch(ds) / 86400) as ic from {source} group by 1) m
                   on m.{key} = s.{key} group by 1, 2) e on e.{key} = t.{key} and e.w = ww.w
      group by all"""


@QUERIES.add(
    "M13",
    sql(
        "select codigo, ds, round(y, 6) as y, clase, dias, round(media, 6) as media from series",
        "last",
        **_SERIES,
    ),
)
def usage_series(spark, sf_dir):
    return forecast.usage_series(forecast.machine_days(timeline(spark, sf_dir))).select(
        "codigo", "ds", r("y"), "clase", "dias", r("media")
    )


_EFFECT_COLUMNS = ", ".join(f"round(efectos[{d + 1}], 6) as efecto_{d}" for d in range(7))


@QUERIES.add(
    "M14",
    sql(
        f"""select codigo, round(pendiente, 8) as pendiente, round(media, 6) as media, ultimo as ultimo_dia, dias,
              {_EFFECT_COLUMNS} from fit""",
        "last",
        **_SERIES,
        fit=_fitted("codigo", "series", 15),
    ),
)
def usage_models(spark, sf_dir):
    rows = forecast.fit_trend_week(forecast.usage_series(forecast.machine_days(timeline(spark, sf_dir))))
    return rows.select(
        "codigo", F.round("pendiente", 8).alias("pendiente"), r("media"), "ultimo_dia", "dias",
        *[r(f"efecto_{d}") for d in range(7)],
    )


@QUERIES.add(
    "M15",
    sql(
        f"""select clase, round(pendiente, 8) as pendiente, round(media, 6) as media, ultimo as ultimo_dia, dias,
              equipos as equipos_en_clase, {_EFFECT_COLUMNS}
            from fit join (select clase, count(distinct codigo) as equipos from series group by 1
                           having count(distinct codigo) >= 2) using (clase)""",
        "last",
        **_SERIES,
        pooled="select clase, ds, avg(y) as y from series group by 1, 2",
        fit=_fitted("clase", "pooled", 10),
    ),
)
def usage_class_models(spark, sf_dir):
    rows = forecast.fit_class(forecast.usage_series(forecast.machine_days(timeline(spark, sf_dir))))
    return rows.select(
        "clase", F.round("pendiente", 8).alias("pendiente"), r("media"), "ultimo_dia", "dias", "equipos_en_clase",
        *[r(f"efecto_{d}") for d in range(7)],
    )


_HORIZON = {
    **_SERIES,
    "fit": _fitted("codigo", "series", 15),
    "hz": f"""select codigo, media,
             greatest(0e0, coalesce(sum(yhat) filter (ds > date '{AS_OF[:10]}' and ds <= date '{AS_OF[:10]}' + 7), 0e0)) as f7,
             greatest(0e0, coalesce(sum(yhat) filter (ds > date '{AS_OF[:10]}' and ds <= date '{AS_OF[:10]}' + 30), 0e0)) as f30
           from (select codigo, media, ds,
                   intercepto + pendiente * epoch(ds) / 86400 + efectos[isodow(ds)] as yhat
                 from (select *, cast(ultimo + cast(unnest(range(1, 31)) as int) as date) as ds from fit))
           group by 1, 2""",
}


@QUERIES.add(
    "M16 J05",
    sql(
        """select codigo, modelo as modelo_usado, 'individual' as tipo_modelo, round(f7, 5) as forecast_7d_h,
             round(f30, 5) as forecast_30d_h,
             round(case when f30 > 0 then f30 / 30 else media end, 5) as horas_por_dia, 'ALTA' as confianza
           from (select a.codigo, coalesce(own.codigo, fst.codigo) as modelo, coalesce(own.f7, fst.f7) as f7,
                   coalesce(own.f30, fst.f30) as f30, coalesce(own.media, fst.media) as media
                 from (select distinct codigo from tl) a left join hz own on own.codigo = a.codigo
                 cross join (select * from hz order by codigo limit 1) fst)""",
        "last",
        **_HORIZON,
    ),
)
def usage_forecast(spark, sf_dir):
    rows = forecast.predict(timeline(spark, sf_dir), AS_OF)
    return rows.select(
        "codigo", "modelo_usado", "tipo_modelo", r("forecast_7d_h", 5), r("forecast_30d_h", 5),
        r("horas_por_dia", 5), "confianza",
    )


@QUERIES.add(
    "M17",
    sql(
        """select codigo, round(forecast_7d_h, 6) as forecast_7d_h, round(forecast_30d_h, 6) as forecast_30d_h,
             round(horas_por_dia, 6) as horas_por_dia, modelo_usado, tipo_modelo, confianza,
             round(factor_actividad, 6) as factor_actividad from forecast""",
        "forecast",
    ),
)
def usage_forecast_rules(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    rows = forecast.rule_forecast(machine_stats(rows), fleet_stats(rows))
    return rows.select(
        "codigo", r("forecast_7d_h"), r("forecast_30d_h"), r("horas_por_dia"), "modelo_usado", "tipo_modelo",
        "confianza", r("factor_actividad"),
    )


@QUERIES.add(
    "M17",
    sql(
        """select codigo, round(h * 7, 6) as forecast_7d_h, round(h * 30, 6) as forecast_30d_h,
             round(h, 6) as horas_por_dia, 'FALLBACK' as modelo_usado, 'simple' as tipo_modelo, 'BAJA' as confianza
           from (select codigo, case when avg(ciclo_horas) > 0 then avg(ciclo_horas) else 8e0 end as h
                 from tl group by 1)""",
        "tl",
    ),
)
def usage_forecast_last_resort(spark, sf_dir):
    rows = forecast.machine_mean_forecast(timeline(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("forecast_7d_h", "forecast_30d_h", "horas_por_dia")})


@QUERIES.add(
    "M18 J09",
    sql(
        f"""select codigo, date '{AS_OF[:10]}' + cast(dias as int) as fecha_servicio_sugerida,
              dias as dias_hasta_servicio, riesgo as riesgo_disponibilidad,
              round(hpd * dias, 6) as horas_proyectadas,
              case riesgo when 'ALTO' then concat('🔴 URGENTE: Programar mantenimiento en ', dias,
                     ' días. Alta probabilidad de falla.')
                   when 'MEDIO' then concat('🟠 ATENCIÓN: Ventana de ', dias,
                     ' días para mantenimiento. Monitorear uso intensivo.')
                   else concat('🟢 NORMAL: Mantenimiento programado en ', dias, ' días. Operación estable.')
              end as recomendacion
            from (select codigo, horas_por_dia as hpd,
                    case when horas_por_dia > 0 and rul50_d > 0
                         then greatest(1, cast(trunc(rul50_d * 8e-1) as bigint)) else 15 end as dias,
                    case when rul90_d < 7 then 'ALTO' when rul50_d < 14 and horas_por_dia > 12 then 'MEDIO'
                         else 'BAJO' end as riesgo
                  from forecast join rul using (codigo))""",
        "forecast",
        "rul",
    ),
)
def service_recommendations(spark, sf_dir):
    stats, fleet = shared_stats(timeline(spark, sf_dir))
    use, life = forecast.rule_forecast(stats, fleet), rul.rule_rul(stats, fleet, AS_OF)
    out = forecast.recommend(use, life, AS_OF)
    return out.withColumn("horas_proyectadas", F.round("horas_proyectadas", 6))


# ---------------------------------------------------------------- anomalies


def _rounded(names):
    return [r(c) if c not in _COUNTS else big(c) for c in names]


_COUNTS = {
    "ingresos_30d", "ingresos_60d", "sistemas_unicos_30d", "sistema_dominante_30d", "sistemas_unicos_60d",
    "dia_semana", "mes", "es_fin_semana",
}

_FEATURES = {
    "ix": _INDEXED,
    "sp": _SYSTEM_PAIRS,
    "fx": f"""select *, count(*) over w as ingresos_30d, count(*) over v as ingresos_60d,
                coalesce(quantile_cont(tbf_dias, 5e-1) over w, 0e0) as tbf_med_30d,
                case when count(tbf_dias) over w = 0 then 0e0 else stddev_samp(tbf_dias) over w end as tbf_std_30d,
                coalesce(min(tbf_dias) over w, 0e0) as tbf_min_30d, coalesce(max(tbf_dias) over w, 0e0) as tbf_max_30d,
                coalesce(quantile_cont(tbf_dias, 5e-1) over v, 0e0) as tbf_med_60d,
                case when count(tbf_dias) over v >= 3 then coalesce(regr_slope(tbf_dias, i) over v, 0e0)
                     else 0e0 end as tbf_trend,
                quantile_cont(ciclo_horas, 5e-1) over w as mttr_med_30d, stddev_samp(ciclo_horas) over w as mttr_std_30d,
                max(ciclo_horas) over w as mttr_max_30d, quantile_cont(ciclo_horas, 5e-1) over v as mttr_med_90d,
                case when count(*) over (partition by codigo order by epoch_us(fecha_in)
                  range between 1 following and 2592000000000 following) >= 2 then 'pre_falla' else 'normal' end as periodo
              from ix window w as {_CLOSED30}, v as {_CLOSED60}""",
    "ft": """select codigo, visit_id, fecha_in, periodo, ingresos_30d, ingresos_60d, tbf_med_30d, tbf_std_30d,
               tbf_min_30d, tbf_max_30d, tbf_med_60d, tbf_trend, u30 as sistemas_unicos_30d,
               dom as sistema_dominante_30d, 1 - dom / greatest(1, ingresos_30d) as diversidad_sistemas_30d,
               u60 as sistemas_unicos_60d, mttr_med_30d, mttr_std_30d, mttr_max_30d, mttr_med_90d,
               isodow(fecha_in) - 1 as dia_semana, month(fecha_in) as mes,
               case when isodow(fecha_in) >= 6 then 1 else 0 end as es_fin_semana,
               ingresos_30d / greatest(1, ingresos_60d - ingresos_30d) as ratio_actividad_30_60,
               case when tbf_med_60d > 0 then tbf_med_30d / tbf_med_60d else 1e0 end as cambio_tbf,
               case when mttr_med_90d > 0 then mttr_med_30d / mttr_med_90d else 1e0 end as cambio_mttr
             from fx join sp using (visit_id) where rn >= 5""",
}


@QUERIES.add(
    "M19 D07 W10 W11 W12 W13 W14 W15 W16",
    sql(
        "select visit_id, codigo, periodo, "
        + ", ".join(
            f"cast({c} as bigint) as {c}" if c in _COUNTS else f"round({c}, 6) as {c}" for c in anomaly.FEATURES
        )
        + " from ft",
        "tl",
        **_FEATURES,
    ),
)
def anomaly_features(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return anomaly.feature_table(rows, cuts).select(
        "visit_id", "codigo", "periodo", *_rounded(anomaly.FEATURES)
    )


@QUERIES.add("M20")
def anomaly_forest_scores(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    table = materialise(anomaly.feature_table(rows, cuts))
    return anomaly.score(table, anomaly.fit(table)).select(
        "codigo", "visit_id", r("anomaly_score"), "anomala"
    )


@QUERIES.add(
    "M21",
    sql(
        """select equipo, dia_anio, round(1 - (rul_estimado - lo) / (hi - lo), 6) as normalizado
           from telemetry cross join (select min(rul_estimado) as lo, max(rul_estimado) as hi from telemetry)""",
        "telemetry",
    ),
)
def normalised_scores(spark, sf_dir):
    rows = anomaly.normalise(telemetry(spark, sf_dir), "rul_estimado")
    return rows.select("equipo", "dia_anio", r("normalizado"))


@QUERIES.add("M22 M20")
def anomaly_latest(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    table = materialise(anomaly.feature_table(rows, cuts))
    return anomaly.latest_scores(rows, anomaly.score(table, anomaly.fit(table)))


@QUERIES.add(
    "M23 W18",
    sql(
        """select codigo, round(anomaly_score, 6) as anomaly_score, banda, ingresos_recientes,
             round(ingresos_promedio, 6) as ingresos_promedio, tbf_reciente,
             cast(sistemas_recientes as bigint) as sistemas_recientes from anomaly""",
        "anomaly",
    ),
)
def anomaly_rules(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    rows = anomaly.rule_score(machine_stats(rows, cuts))
    return rows.select(
        "codigo", r("anomaly_score"), "banda", "ingresos_recientes", r("ingresos_promedio"), "tbf_reciente",
        big("sistemas_recientes"),
    )


# ---------------------------------------------------------------- telemetry


@QUERIES.add("M24")
def telemetry_regressors(spark, sf_dir):
    readings = materialise(telemetry(spark, sf_dir))
    scored = tm.score(tm.fit(readings), readings)
    return scored.select("equipo", "fecha", r("fr30_risk"), "rul_days")


@QUERIES.add("M25")
def telemetry_anomalies(spark, sf_dir):
    readings = materialise(telemetry(spark, sf_dir))
    return tm.score_anomaly(tm.fit_anomaly(readings), readings).select(
        "equipo", "fecha", r("anomaly_score"), "banda"
    )


@QUERIES.add(
    "M26",
    sql(
        """select equipo, dia_anio,
             round(least(1e0, (vibracion * 1e-1 + greatest(0e0, temperatura - 80) * 1e-2 + horas_operacion * 2e-2) / 10), 6)
               as fr30_risk,
             greatest(10, cast(trunc(round(200 - vibracion * 20 - greatest(0e0, temperatura - 85) * 3, 9)) as bigint)) as rul_days,
             round(least(1e0, (vibracion + greatest(0e0, temperatura - 75)) / 100), 6) as anomaly_score
           from v""",
        "tb",
        v="select equipo, dia_anio, temperatura, round(vibracion, 9) as vibracion, horas_operacion from tb",
    ),
)
def telemetry_closed_form(spark, sf_dir):
    """Vibration enters with nine decimals, so that whole days do not hang on the last bit."""
    readings = telemetry_from_lineitem(spark, sf_dir).withColumn("vibracion", F.round("vibracion", 9))
    rows = tm.closed_form(readings, "additive")
    return rows.select("equipo", "dia_anio", r("fr30_risk"), "rul_days", r("anomaly_score"))


@QUERIES.add(
    "M27",
    sql(
        """select equipo, dia_anio,
             round(greatest(5e-2, least(95e-2, greatest(0e0, (temperatura - 70) / 30) * 4e-1
               + least(1e0, vibracion / 5) * 4e-1 + least(1e0, horas_operacion / 20) * 2e-1)), 6) as fr30_risk,
             greatest(15, cast(trunc(180 - ((temperatura - 65) / 100 + vibracion / 10) * 100) as bigint)) as rul_days,
             round(greatest(-1e0, least(1e0, abs(temperatura - 75) / 50 + vibracion / 10 - 5e-1)), 6) as anomaly_score
           from v""",
        "tb",
        v="select equipo, dia_anio, temperatura, round(vibracion, 9) as vibracion, horas_operacion from tb",
    ),
)
def telemetry_closed_form_weighted(spark, sf_dir):
    readings = telemetry_from_lineitem(spark, sf_dir).withColumn("vibracion", F.round("vibracion", 9))
    rows = tm.closed_form(readings, "weighted")
    return rows.select("equipo", "dia_anio", r("fr30_risk"), "rul_days", r("anomaly_score"))


@QUERIES.add(
    "M29",
    sql(
        """select round(regr_slope(p, dia_anio), 9) as pendiente, round(regr_intercept(p, dia_anio), 9) as intercepto
           from (select dia_anio, avg(prob_falla_30d) as p from telemetry group by 1)""",
        "telemetry",
    ),
)
def risk_trend_line(spark, sf_dir):
    rows = tm.trend(telemetry(spark, sf_dir))
    return rows.select(r("pendiente", 9), r("intercepto", 9))


_PROJECTED = {
    "rec": f"""select equipo, cast(fecha as date) as fecha, avg(prob_falla_30d) as riesgo from telemetry
               where fecha >= timestamp '{TELEMETRY_AS_OF}' - interval '29' day
                 and fecha < timestamp '{TELEMETRY_AS_OF}' + interval '1' day group by 1, 2""",
    "line": f"""select equipo, case when count(*) > 1 then regr_slope(riesgo, fecha - date '{TELEMETRY_AS_OF}') else 0e0 end as sl,
                  max_by(riesgo, fecha) as ult from rec group by 1""",
    "proj": f"""select equipo, date '{TELEMETRY_AS_OF}' + cast(i as int) as fecha,
                  greatest(0e0, least(1e0, ult + sl * i)) as riesgo, i
                from line cross join (select unnest(range(1, 31)) as i)""",
}


@QUERIES.add(
    "M30 J08",
    sql(
        """select equipo, fecha, round(greatest(0e0, least(1e0, riesgo)), 6) as riesgo, 'histórico' as tipo from rec
           union all select equipo, fecha, round(riesgo, 6), 'pronóstico' from proj""",
        "telemetry",
        **_PROJECTED,
    ),
)
def risk_projection(spark, sf_dir):
    rows = tm.project(telemetry(spark, sf_dir), TELEMETRY_AS_OF)
    return rows.withColumn("riesgo", F.round("riesgo", 6))


@QUERIES.add(
    "M28 F-BAND",
    sql(
        """select equipo, cast(printf('%.3f', risk) as double) as risk_30d, concat(printf('%.1f', risk * 100), '%') as risk_percentage,
             case when risk >= 5e-1 then '🔴 ALTO' when risk >= 25e-2 then '🟠 MEDIO' else '🟢 BAJO' end as status,
             case when risk >= 5e-1 then 'danger' when risk >= 25e-2 then 'warning' else 'success' end as badge_color,
             days as rul50_d, cast(trunc(days * 7e-1) as bigint) as rul90_d,
             cast(printf('%.2f', an) as double) as anomaly_score,
             case when an >= 6e-1 then '🔴 CRÍTICO' when an >= 3e-1 then '🟡 ATENCIÓN' else '🟢 NORMAL' end as anomaly_status,
             case when an >= 6e-1 then 'danger' when an >= 3e-1 then 'warning' else 'success' end as anomaly_color,
             cast(printf('%.1f', wk) as double) as forecast_7d, cast(printf('%.1f', wk * 42e-1) as double) as forecast_30d,
             case when wk > 20 then 'Ascendente' else 'Estable' end as trend_direction,
             concat('RandomForest ML - Predicción para ', equipo) as explicacion_fr30,
             concat('ML Regression - Vida útil para ', equipo) as explicacion_rul,
             concat('Isolation Forest - Detección anomalías ', equipo) as explicacion_anomaly,
             concat('ML Time Series - Pronóstico para ', equipo) as explicacion_forecast
           from sc left join (select equipo, round(avg(riesgo) * 100, 9) as wk from proj where i <= 7 group by 1) using (equipo)""",
        "telemetry",
        **_PROJECTED,
        mm="""select equipo, round(avg(temperatura), 9) as t, round(avg(vibracion), 9) as v, round(avg(horas_operacion), 9) as h
              from telemetry where fecha >= timestamp '2001-11-01' and fecha < timestamp '2001-12-01' group by 1""",
        sc="""select equipo, least(1e0, (v * 1e-1 + greatest(0e0, t - 80) * 1e-2 + h * 2e-2) / 10) as risk,
                greatest(10, cast(trunc(200 - v * 20 - greatest(0e0, t - 85) * 3) as bigint)) as days,
                (least(1e0, (v + greatest(0e0, t - 75)) / 100) + 1) / 2 as an from mm""",
    ),
)
def month_indicators(spark, sf_dir):
    return tm.month_kpis(telemetry(spark, sf_dir), "2001-11", TELEMETRY_AS_OF)


@QUERIES.add(
    "IO13",
    sql(
        """select clase, round(lam, 6) as lambda, round(k, 6) as k, cast(total as bigint) as n_observaciones from w""",
        "tl",
        **_WEIBULL,
    ),
)
def saved_parameters(spark, sf_dir):
    """Weibull parameters after a round trip through storage."""
    path = scratch_folder(spark, "weibull")
    save_model(rul.fit_weibull(rul.intervals(timeline(spark, sf_dir))), path, spark)
    return load_model("table", path, spark).select("clase", r("lambda"), r("k"), "n_observaciones")


@QUERIES.add("IO13 M20")
def saved_forest_scores(spark, sf_dir):
    """Telemetry scored with a forest that was saved and loaded."""
    readings = materialise(telemetry(spark, sf_dir))
    path = scratch_folder(spark, "forest")
    save_model(tm.fit_anomaly(readings), path, spark)
    # written once: the limit is taken from the written scores
    scored = decision(materialise(score_forest(readings, load_model("forest", path, spark))))
    return scored.select("equipo", "fecha", r("score"), r("decision"))


