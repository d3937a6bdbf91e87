"""Combined indicators, alerts, explanations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bands import BANDS, band, urgency
from ..functions.explain import (
    anomaly_reasons,
    explain_anomaly,
    explain_forecast,
    explain_fr30,
    explain_rul,
)
from ..functions.fmt import fmt
from ..operators.features import latest_per_machine
from ..operators.machine_stats import fleet_stats, machine_stats
from ..plans import anomaly, forecast, fr30, history, kpi, rul
from ..sources import exports
from ..sources.adapters import AS_OF, table
from ..storage import materialise, scratch_folder
from .base import Registry, joined, r, sql, timeline, timeline_and_cuts
from .history import MONTHS
from .models import _FEATURES
from .reports import telemetry

QUERIES = Registry()

_RULES = ("fr30", "rul", "forecast", "anomaly")


def rule_tables(spark, sf_dir):
    """The four rule-based indicator tables from one pass over the log."""
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    return kpi.rule_indicators(rows, AS_OF, cuts)


def rule_kpis(spark, sf_dir):
    return kpi.assemble(*rule_tables(spark, sf_dir))


def known_kpis(spark, sf_dir):
    """As above, with nulls where an indicator is missing."""
    return kpi.combine(*rule_tables(spark, sf_dir))


def partial_kpis(spark, sf_dir):
    """Machine types that have some indicators only."""
    f, u, p, a = rule_tables(spark, sf_dir)
    code = F.col("codigo")
    return kpi.combine(
        f.filter(code.startswith("VD")),
        u.filter(~code.startswith("VD")),
        p.filter(code.startswith("C")),
        a.filter(code.startswith("EX")),
    )


_KPI_SQL = """codigo, round(fr30_risk, 6) as fr30_risk, fr30_banda, round(rul50_d, 6) as rul50_d,
  round(rul90_d, 6) as rul90_d, round(forecast_7d_h, 6) as forecast_7d_h,
  round(forecast_30d_h, 6) as forecast_30d_h, round(horas_por_dia, 6) as horas_por_dia,
  round(anomaly_score, 6) as anomaly_score, anomaly_banda"""


def _kpi_columns(df, key="codigo"):
    texts = ("fr30_banda", "anomaly_banda")
    names = [*kpi.NUMBERS, "anomaly_score"]
    return df.select(key, *texts, *[r(c) for c in names])


@QUERIES.add("J01 M05", sql(f"select {_KPI_SQL} from kpis", "kpis"))
def combined_indicators(spark, sf_dir):
    return _kpi_columns(rule_kpis(spark, sf_dir))


@QUERIES.add(
    "J01",
    sql(
        """select codigo, round(coalesce(f.risk_30d, 0e0), 6) as fr30_risk, coalesce(f.banda, '') as fr30_banda,
             round(coalesce(u.rul50_d, 0e0), 6) as rul50_d, round(coalesce(p.forecast_7d_h, 0e0), 6) as forecast_7d_h,
             round(coalesce(a.anomaly_score, 0e0), 6) as anomaly_score, coalesce(a.banda, '') as anomaly_banda
           from (select * from fr30 where starts_with(codigo, 'VD')) f
             full join (select * from rul where not starts_with(codigo, 'VD')) u using (codigo)
             full join (select * from forecast where starts_with(codigo, 'C')) p using (codigo)
             full join (select * from anomaly where starts_with(codigo, 'EX')) a using (codigo)""",
        *_RULES,
    ),
)
def combined_indicators_partial(spark, sf_dir):
    """Machine types that have some indicators only: the others default."""
    f, u, p, a = rule_tables(spark, sf_dir)
    code = F.col("codigo")
    rows = kpi.assemble(
        f.filter(code.startswith("VD")),
        u.filter(~code.startswith("VD")),
        p.filter(code.startswith("C")),
        a.filter(code.startswith("EX")),
    )
    return rows.select(
        "codigo", r("fr30_risk"), "fr30_banda", r("rul50_d"), r("forecast_7d_h"), r("anomaly_score"), "anomaly_banda"
    )


_PARTIAL = """(select codigo, f.risk_30d as fr30_risk, u.rul50_d, u.rul90_d, p.forecast_30d_h, a.anomaly_score
  from (select * from fr30 where starts_with(codigo, 'VD')) f
    full join (select * from rul where not starts_with(codigo, 'VD')) u using (codigo)
    full join (select * from forecast where starts_with(codigo, 'C')) p using (codigo)
    full join (select * from anomaly where starts_with(codigo, 'EX')) a using (codigo))"""


@QUERIES.add(
    "A24",
    sql(
        """select (select count(distinct codigo) from (select codigo from r union all select codigo from u
               union all select codigo from a)) as total_equipos,
             (select count(*) from r where risk_30d >= 0.5) as fr30_alto,
             (select count(*) from r where risk_30d >= 0.3 and risk_30d < 0.5) as fr30_medio,
             (select count(*) from r where risk_30d < 0.3) as fr30_bajo,
             (select count(*) from u where rul90_d < 7) as rul_critico,
             (select count(*) from u where rul90_d >= 7 and rul90_d < 21) as rul_alerta,
             (select count(*) from u where rul90_d >= 21) as rul_normal,
             (select count(*) from a where anomaly_score >= 0.8) as anomalia_alta,
             (select count(*) from a where anomaly_score >= 0.6 and anomaly_score < 0.8) as anomalia_media,
             (select count(*) from a where anomaly_score < 0.6) as anomalia_baja""",
        *_RULES,
        r="select * from fr30 where starts_with(codigo, 'VD')",
        u="select * from rul where not starts_with(codigo, 'VD')",
        a="select * from anomaly where starts_with(codigo, 'EX')",
    ),
)
def band_counts_partial(spark, sf_dir):
    """Each indicator counts the machines of its own table."""
    return kpi.band_counts(partial_kpis(spark, sf_dir))


@QUERIES.add(
    "A25 A26",
    sql(
        f"""select (select count(*) from {_PARTIAL} where coalesce(fr30_risk, rul50_d, anomaly_score) is not null) as total_equipos,
             (select count(*) from fr30 where starts_with(codigo, 'VD') and risk_30d >= 0.5) as equipos_alto_riesgo,
             (select count(*) from rul where not starts_with(codigo, 'VD') and rul90_d < 7) as equipos_mantenimiento_urgente,
             (select count(*) from anomaly where starts_with(codigo, 'EX') and anomaly_score >= 0.6) as equipos_con_anomalias,
             (select round(avg(risk_30d), 6) from fr30 where starts_with(codigo, 'VD')) as promedio_fr30,
             (select round(avg(rul50_d), 6) from rul where not starts_with(codigo, 'VD')) as promedio_rul50""",
        *_RULES,
    ),
)
def executive_summary_partial(spark, sf_dir):
    rows = kpi.executive_summary(partial_kpis(spark, sf_dir))
    return rows.drop("total_horas_pronosticadas_30d").withColumns({c: F.round(c, 6) for c in ("promedio_fr30", "promedio_rul50")})


@QUERIES.add("J07", sql("select codigo from fr30 union select codigo from rul union select codigo from anomaly", *_RULES))
def machines_with_indicators(spark, sf_dir):
    f, u, _, a = rule_tables(spark, sf_dir)
    return kpi.all_machines(f, u, a)


@QUERIES.add(
    "J02 FMT",
    sql(
        """select codigo as equipo, concat(printf('%.1f', fr30_risk * 100), '%') as fr30, fr30_banda as banda_fr30,
             concat(printf('%.0f', rul50_d), 'd') as rul50, concat(printf('%.0f', rul90_d), 'd') as rul90,
             concat(printf('%.0f', forecast_7d_h), 'h') as pronostico_7d,
             concat(printf('%.0f', forecast_30d_h), 'h') as pronostico_30d,
             printf('%.2f', anomaly_score) as anomalia, anomaly_banda as banda_anomalia
           from kp""",
        "kpis",
        kp="select * replace (round(forecast_7d_h, 9) as forecast_7d_h, round(forecast_30d_h, 9) as forecast_30d_h) from kpis",
    ),
)
def summary_table(spark, sf_dir):
    f, u, p, a = rule_tables(spark, sf_dir)
    # averages enter with nine decimals, so that text does not hang on the last bit
    p = p.withColumns({c: F.round(c, 9) for c in ("forecast_7d_h", "forecast_30d_h")})
    return kpi.summary_table(f, u, p, a)


@QUERIES.add(
    "J03",
    sql(
        """select codigo, round(rul50_d, 6) as rul50_d, fr30_risk, round(anomaly_score, 6) as anomaly_score,
             case when rul50_d < 30 and fr30_risk >= 5e-1 then 'rul_critico_riesgo_alto'
                  when rul50_d < 30 then 'rul_critico' when fr30_risk >= 5e-1 then 'riesgo_alto'
                  else 'normal' end as cuadrante from kpis""",
        "kpis",
    ),
)
def risk_life_scatter(spark, sf_dir):
    f, u, _, a = rule_tables(spark, sf_dir)
    return kpi.scatter_table(f, u, a).select("codigo", r("rul50_d"), "fr30_risk", r("anomaly_score"), "cuadrante")


@QUERIES.add(
    "A24",
    sql(
        """select count(*) as total_equipos, count(*) filter (fr30_risk >= 5e-1) as fr30_alto,
             count(*) filter (fr30_risk >= 3e-1 and fr30_risk < 5e-1) as fr30_medio,
             count(*) filter (fr30_risk < 3e-1) as fr30_bajo, count(*) filter (rul90_d < 7) as rul_critico,
             count(*) filter (rul90_d >= 7 and rul90_d < 21) as rul_alerta,
             count(*) filter (rul90_d >= 21) as rul_normal, count(*) filter (anomaly_score >= 8e-1) as anomalia_alta,
             count(*) filter (anomaly_score >= 6e-1 and anomaly_score < 8e-1) as anomalia_media,
             count(*) filter (anomaly_score < 6e-1) as anomalia_baja from kpis""",
        "kpis",
    ),
)
def band_counts(spark, sf_dir):
    return kpi.band_counts(known_kpis(spark, sf_dir))


@QUERIES.add(
    "A25",
    sql(
        """select count(*) as total_equipos, count(*) filter (fr30_risk >= 5e-1) as equipos_alto_riesgo,
             count(*) filter (rul90_d < 7) as equipos_mantenimiento_urgente,
             count(*) filter (anomaly_score >= 6e-1) as equipos_con_anomalias,
             round(avg(fr30_risk), 6) as promedio_fr30, round(avg(rul50_d), 6) as promedio_rul50,
             round(sum(forecast_30d_h), 4) as total_horas_pronosticadas_30d,
             (select anomalias_detectadas_mes from lastm) as anomalias_detectadas_mes,
             (select fr30_trend from lastm) as fr30_trend, (select rul_trend from lastm) as rul_trend,
             (select usage_trend from lastm) as usage_trend, (select anomaly_trend from lastm) as anomaly_trend
           from kpis""",
        "kpis",
        "hist",
        months=MONTHS,
        lastm="select * from months order by mes desc limit 1",
    ),
)
def executive_summary(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    # the last month ends at the date of all other tables, so it is the state of now
    months = materialise(history.indicator_history(rows, AS_OF, cuts))
    rows = kpi.executive_summary(months.filter(F.col("mes") == AS_OF[:7]), history.month_summary(months))
    return rows.withColumns(
        {
            "promedio_fr30": F.round("promedio_fr30", 6),
            "promedio_rul50": F.round("promedio_rul50", 6),
            "total_horas_pronosticadas_30d": F.round("total_horas_pronosticadas_30d", 4),
        }
    )


@QUERIES.add(
    "A25",
    sql(
        """select 'fr30' as kpi, case when fr30_risk >= 5e-1 then '🔴 ALTO' when fr30_risk >= 25e-2 then '🟠 MEDIO'
             else '🟢 BAJO' end as banda, count(*) as equipos from kpis group by 2
           union all select 'anomaly', case when anomaly_score >= 6e-1 then '🔴 CRÍTICO'
             when anomaly_score >= 3e-1 then '🟡 ATENCIÓN' else '🟢 NORMAL' end, count(*) from kpis group by 2""",
        "kpis",
    ),
)
def band_distribution(spark, sf_dir):
    return kpi.band_distribution(known_kpis(spark, sf_dir))


@QUERIES.add(
    "A26",
    sql(
        """select round(avg(case when fr30_risk >= 5e-1 then 1e0 else 0e0 end) * 100, 6) as equipos_alto_riesgo_pct,
             round(avg(rul50_d), 6) as rul_promedio from kpis""",
        "kpis",
    ),
)
def bi_measures(spark, sf_dir):
    rows = kpi.bi_measures(known_kpis(spark, sf_dir))
    return rows.select(r("equipos_alto_riesgo_pct"), r("rul_promedio"))


@QUERIES.add(
    "A26",
    sql(
        """select codigo, round(rul50_d, 6) as rul50_d, case when rul50_d <= 14 then '🔴 URGENTE'
             when rul50_d <= 30 then '🟠 PRÓXIMO' else '🟢 OK' end as alerta from kpis""",
        "kpis",
    ),
)
def maintenance_alerts(spark, sf_dir):
    return kpi.maintenance_alerts(known_kpis(spark, sf_dir)).select("codigo", r("rul50_d"), "alerta")


@QUERIES.add(
    "A27",
    sql(
        """select codigo, 'alto_riesgo_fr30' as alerta, round(fr30_risk, 6) as valor from kpis where fr30_risk > 4e-1
           union all select codigo, 'rul_critico', round(rul50_d, 6) from kpis where rul50_d < 20
           union all select codigo, 'anomalia', round(anomaly_score, 6) from kpis where anomaly_score > 5e-1""",
        "kpis",
    ),
)
def alert_list(spark, sf_dir):
    return kpi.alerts(known_kpis(spark, sf_dir)).select("codigo", "alerta", r("valor"))


@QUERIES.add(
    "A27",
    sql(
        """select round(avg(fr30_risk), 6) as fr30_promedio, round(avg(rul50_d), 6) as rul50_promedio,
             round(avg(anomaly_score), 6) as anomalia_promedio from kpis""",
        "kpis",
    ),
)
def indicator_means(spark, sf_dir):
    rows = kpi.alert_means(known_kpis(spark, sf_dir))
    return rows.select(*[r(c) for c in rows.columns])


@QUERIES.add(
    "A28 C09",
    sql(
        """select codigo, case when n >= 5 then 25e-2 else 15e-2 end as risk_30d,
             case when n >= 5 then '🟠 MEDIO' else '🟢 BAJO' end as fr30_banda,
             round(greatest(30e0, t * 7e-1), 6) as rul50_d, round(greatest(15e0, t * 5e-1), 6) as rul90_d,
             round(m * 5e-1, 6) as forecast_7d_h, round(m * 2, 6) as forecast_30d_h, round(s, 6) as anomaly_score,
             case when s < 3e-1 then '🟢 NORMAL' else '🟠 ATENCIÓN' end as anomaly_banda
           from (select codigo, count(*) as n, median(tbf_dias) as t, median(mttr_horas) as m,
                   least(8e-1, 2e-1 * count(*) filter (fecha_in >= timestamp '2001-06-01'
                     and fecha_in < timestamp '2001-07-01')) as s
                 from tl group by codigo having count(*) >= 3)""",
        "tl",
    ),
)
def basic_estimates(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    out = kpi.basic_estimate(rows, "2001-06", cuts=cuts)
    numbers = ("rul50_d", "rul90_d", "forecast_7d_h", "forecast_30d_h", "anomaly_score")
    return out.withColumns({c: F.round(c, 6) for c in numbers})


@QUERIES.add(
    "A31",
    sql(
        """select equipo, mes, round(valor, 6) as valor,
             case when ch > 5e-2 then 'creciente' when ch < -5e-2 then 'decreciente'
                  when ch is not null then 'estable' end as tendencia
           from (select *, case when ant <> 0 then (valor - ant) / abs(ant) end as ch
                 from (select *, lag(valor) over (partition by equipo order by mes) as ant
                       from (select equipo, strftime(fecha, '%Y-%m') as mes, round(avg(prob_falla_30d), 9) as valor
                             from telemetry group by 1, 2)))""",
        "telemetry",
    ),
)
def indicator_trends(spark, sf_dir):
    monthly = kpi.monthly_value(telemetry(spark, sf_dir), "equipo", "fecha", "prob_falla_30d")
    monthly = monthly.withColumn("valor", F.round("valor", 9))
    return kpi.trend_label(monthly, "valor", "equipo").select("equipo", "mes", r("valor"), "tendencia")


# ---------------------------------------------------------------- explanations


@QUERIES.add(
    "X01",
    sql(
        """select codigo, concat('Equipo ', codigo, ' presenta riesgo de falla 30d = ', printf('%.2f', risk_30d), '. ',
               case when risk_30d >= 5e-1 then 'Requiere atención inmediata.' when risk_30d >= 3e-1
                    then 'Monitoreo recomendado.' else 'Operación normal.' end) as resumen,
             array_to_string(case when len(d) > 0 then d[1:3] when risk_30d < 3e-1
               then ['Operación estable con patrones normales de falla']
               else ['Múltiples factores menores contribuyen al riesgo'] end, ' | ') as drivers,
             case when risk_30d >= 5e-1 then 'Inspección inmediata de sistemas críticos | Verificar disponibilidad de repuestos prioritarios'
                  when risk_30d >= 3e-1 then 'Programar inspección preventiva | Revisar historial de mantenimiento'
                  else 'Continuar con programa normal de mantenimiento' end as acciones_1_2_sem,
             t as tbf_actual, n as ingresos_recientes, round(h, 6) as mttr_promedio, c as reincidencia_sistema
           from (select codigo, risk_30d, t, n, h, c, list_filter([
               case when t > 0 and m > 0 and t < m * 7e-1 then concat('TBF actual (', printf('%.0f', t),
                 ' días) significativamente menor al histórico (', printf('%.0f', m), ' días)') end,
               case when n >= 2 then concat('Alta frecuencia de ingresos recientes: ', n, ' en 30 días') end,
               case when h > 48 then concat('MTTR elevado (', printf('%.0f', h), ' horas) indica complejidad de reparaciones') end,
               case when c >= 2 then concat('Reincidencia en mismo sistema: ', c, ' veces en 60 días') end],
               lambda x: x is not null) as d
             from (select l.codigo, f.risk_30d, coalesce(l.tbf_dias, 0e0) as t, coalesce(l.tbf_med_60d, 0e0) as m,
                     l.ingresos_30d as n, l.sistema_count_60d as c, round(l.mttr_eq, 9) as h
                   from lastwf l join fr30 f on f.codigo = l.codigo))""",
        "lastwf",
        "fr30",
    ),
)
def return_risk_explanations(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    state = fr30.current_state(rows, cuts).withColumn("mttr_eq", F.round("mttr_eq", 9))
    risk = fr30.rule_risk(machine_stats(rows)).select("codigo", "risk_30d")
    out = explain_fr30(state.join(risk, "codigo"))
    numbers = F.col("factores_influyentes")
    return out.select(
        "codigo", "resumen", joined("drivers"), joined("acciones_1_2_sem"),
        numbers["tbf_actual"].alias("tbf_actual"), numbers["ingresos_recientes"].alias("ingresos_recientes"),
        F.round(numbers["mttr_promedio"], 6).alias("mttr_promedio"),
        numbers["reincidencia_sistema"].alias("reincidencia_sistema"),
    )


@QUERIES.add(
    "X02 F-BAND",
    sql(
        """select codigo, urgencia, concat('Equipo ', codigo, ': RUL-50 = ', printf('%.0f', rul50_d), ' días, RUL-90 = ',
               printf('%.0f', rul90_d), ' días. Urgencia: ', urgencia) as resumen,
             concat('Intervención recomendada ', case urgencia when 'CRÍTICA' then 'inmediata' when 'ALTA' then 'esta semana'
               when 'MEDIA' then 'próximas 2 semanas' else 'próximo mes' end) as ventana_intervencion,
             concat('Riesgo ', case urgencia when 'CRÍTICA' then 'muy alto de falla inminente'
               when 'ALTA' then 'alto si no se interviene pronto' when 'MEDIA' then 'moderado con ventana de intervención'
               else 'bajo con tiempo suficiente para planificar' end) as riesgos_si_no,
             cast(trunc(rul90_d) as bigint) as urgencia_dias,
             case urgencia when 'CRÍTICA' then 'DÍA 1-2: Inspección inmediata y evaluación de estado'
               || ' | DÍA 3-4: Adquisición urgente de repuestos críticos | DÍA 5-6: Programación de parada y preparación de taller'
               || ' | DÍA 7: Ejecución de mantenimiento mayor | DÍA 8-10: Pruebas y puesta en servicio'
               when 'ALTA' then 'SEMANA 1: Diagnóstico detallado y evaluación de criticidad'
               || ' | SEMANA 1-2: Gestión de repuestos y recursos | SEMANA 2: Coordinación con operaciones para parada programada'
               || ' | SEMANA 3: Ejecución de mantenimiento preventivo/correctivo | SEMANA 3-4: Verificación y retorno a operación normal'
               else 'SEMANA 1-2: Planificación detallada de intervención | SEMANA 3-4: Adquisición de repuestos y materiales'
               || ' | SEMANA 5-6: Coordinación con cronograma operativo | SEMANA 7-8: Ejecución de mantenimiento programado'
               || ' | SEMANA 9: Análisis post-mantenimiento y lecciones aprendidas' end as plan_5_pasos,
             'Componentes de desgaste principal del sistema | Elementos de filtración y lubricación | Piezas con histórico de falla frecuente'
               as repuestos_criticos,
             modelo_usado, round(tbf_base, 6) as tbf_base
           from (select *, case when rul90_d < 7 then 'CRÍTICA' when rul90_d < 21 then 'ALTA'
                     when rul50_d < 45 then 'MEDIA' else 'BAJA' end as urgencia
                 from (select codigo, round(rul50_d, 9) as rul50_d, round(rul90_d, 9) as rul90_d, modelo_usado, tbf_base from rul))""",
        "rul",
    ),
)
def remaining_life_explanations(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    life = rul.rule_rul(machine_stats(rows), fleet_stats(rows), AS_OF)
    life = life.select("codigo", r("rul50_d", 9), r("rul90_d", 9), "modelo_usado", "tbf_base")
    out = explain_rul(life)
    return out.select(
        "codigo", "urgencia", "resumen", "ventana_intervencion", "riesgos_si_no", "urgencia_dias",
        joined("plan_5_pasos"), joined("repuestos_criticos"), F.col("parametros_modelo.modelo_usado").alias("modelo_usado"),
        F.round(F.col("parametros_modelo.tbf_base"), 6).alias("tbf_base"),
    )


@QUERIES.add(
    "X03",
    sql(
        """select codigo, nivel as intensidad_uso, printf('%.1f', hpd) as horas_diarias,
             concat('Proyección uso para ', codigo, ': ', w, 'h/7d y ', m, 'h/30d') as resumen,
             array_to_string([concat('Proyección uso: ', w, 'h/7d y ', m, 'h/30d (intensidad ', nivel, ')'),
               concat('Impacto: ', case nivel when 'MUY ALTA' then 'acelerado desgaste y mayor probabilidad de falla'
                 when 'ALTA' then 'desgaste acelerado requiere monitoreo cercano'
                 when 'MEDIA' then 'uso normal dentro de parámetros esperados'
                 else 'uso reducido permite mantenimiento programado' end),
               concat('Confianza del modelo: ', confianza, ' - Validar con datos operativos'),
               case when alto then 'SCHEDULER: Considerar rotación de equipos para reducir carga'
                    else 'SCHEDULER: Ventana disponible para mantenimiento programado' end,
               case when alto then 'COMPRAS: Acelerar adquisición de repuestos de desgaste'
                    else 'COMPRAS: Proceder con cronograma normal de repuestos' end], ' | ') as bullets_accionables,
             case when alto then 'Rotación de equipos' else 'Mantenimiento programado' end as scheduler,
             case when alto then 'Acelerar repuestos' else 'Cronograma normal' end as compras
           from (select *, nivel in ('MUY ALTA', 'ALTA') as alto from (
             select codigo, confianza, printf('%.0f', round(forecast_7d_h, 9)) as w, printf('%.0f', round(forecast_30d_h, 9)) as m,
               round(horas_por_dia, 9) as hpd, case when round(horas_por_dia, 9) > 16 then 'MUY ALTA'
                 when round(horas_por_dia, 9) > 12 then 'ALTA' when round(horas_por_dia, 9) > 8 then 'MEDIA' else 'BAJA' end as nivel
             from forecast))""",
        "forecast",
    ),
)
def usage_explanations(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    rows = forecast.rule_forecast(machine_stats(rows), fleet_stats(rows))
    numbers = ("forecast_7d_h", "forecast_30d_h", "horas_por_dia")
    out = explain_forecast(rows.withColumns({c: F.round(c, 9) for c in numbers}))
    return out.select(
        "codigo", "intensidad_uso", "horas_diarias", "resumen", joined("bullets_accionables"), "scheduler", "compras"
    )


_LAST_FEATURES = {
    **_FEATURES,
    "lf": """select * from (select *, row_number() over (partition by codigo order by fecha_in desc, visit_id desc) as k
             from ft) where k = 1""",
}


def _latest_features(spark, sf_dir):
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    table = anomaly.feature_table(rows, cuts).withColumnRenamed("fecha", "fecha_in")
    return rows, latest_per_machine(table)


@QUERIES.add(
    "X04",
    sql(
        """select codigo, concat('Equipo ', codigo, ' presenta score de anomalía = ', printf('%.2f', sc)) as resumen,
             array_to_string(case when len(d) > 0 then d[1:3] when sc > 6e-1
               then ['Combinación de factores menores genera patrón atípico']
               else ['Operación dentro de patrones normales'] end, ' | ') as anomalias_detectadas,
             case when sc >= 8e-1 then 'Inspección visual completa del equipo HOY | Verificación de parámetros operativos críticos'
                  when sc >= 6e-1 then 'Revisión de registros de mantenimiento reciente | Análisis de condiciones operativas actuales'
                  else 'Continuar con programa normal de monitoreo' end as chequeos_recomendados
           from (select codigo, sc, list_filter([
               case when tr < -1 then concat('Tendencia decreciente en TBF: ', printf('%.1f', tr), ' días/evento') end,
               case when tbf_med_30d > 0 and tbf_med_30d < 10 then concat('TBF anormalmente bajo: ', printf('%.0f', tbf_med_30d), ' días promedio') end,
               case when ingresos_30d >= 3 then concat('Alta frecuencia: ', ingresos_30d, ' ingresos en 30 días') end,
               case when ra > 2 then concat('Actividad reciente ', printf('%.1f', ra), 'x mayor que histórica') end,
               case when cm > 15e-1 then concat('MTTR aumentó ', printf('%.1f', cm), 'x respecto a histórico') end,
               case when sistemas_unicos_30d > 2 then concat('Múltiples sistemas afectados: ', sistemas_unicos_30d) end],
               lambda x: x is not null) as d
             from (select a.codigo, lf.* exclude (codigo), round(a.anomaly_score, 9) as sc, round(tbf_trend, 9) as tr,
                     round(ratio_actividad_30_60, 9) as ra, round(cambio_mttr, 9) as cm
                   from anomaly a left join lf on a.codigo = lf.codigo))""",
        "anomaly",
        **_LAST_FEATURES,
    ),
)
def anomaly_explanations(spark, sf_dir):
    rows, latest = _latest_features(spark, sf_dir)
    score = anomaly.rule_score(machine_stats(rows)).select("codigo", r("anomaly_score", 9))
    numbers = ("tbf_trend", "ratio_actividad_30_60", "cambio_mttr")
    out = explain_anomaly(latest.withColumns({c: F.round(c, 9) for c in numbers}).join(score, "codigo", "right"))
    return out.select("codigo", "resumen", joined("anomalias_detectadas"), joined("chequeos_recomendados"))


@QUERIES.add(
    "X05",
    sql(
        """select codigo, array_to_string(case when len(d) > 0 then d
             else ['Patrones operativos dentro de rangos normales'] end, ' | ') as explicacion
           from (select codigo, list_filter([
               case when ingresos_30d > 3 then concat('Alta frecuencia de ingresos: ', ingresos_30d, ' en 30 días') end,
               case when round(tbf_trend, 9) < -1 then 'Tendencia decreciente en tiempo entre fallas' end,
               case when sistemas_unicos_30d > 2 then concat('Múltiples sistemas afectados: ', sistemas_unicos_30d) end,
               case when round(cambio_mttr, 9) > 15e-1 then 'Aumento significativo en tiempo de reparación' end],
               lambda x: x is not null) as d from (select distinct codigo from tl) m left join lf using (codigo))""",
        "tl",
        **_LAST_FEATURES,
    ),
)
def anomaly_reason_list(spark, sf_dir):
    visits, latest = _latest_features(spark, sf_dir)
    # machines with too few visits for features have the default text
    every = visits.select("codigo").distinct().join(latest, "codigo", "left")
    rows = every.withColumns({c: F.round(c, 9) for c in ("tbf_trend", "cambio_mttr")})
    return anomaly_reasons(rows).select("codigo", joined("explicacion"))


# ---------------------------------------------------------------- formats, bands, exports


@QUERIES.add(
    "FMT",
    """select o_orderkey, case when v is null then 'N/A' else concat(printf('%.1f', v / 1000 * 100), '%') end as porcentaje,
         case when v is null then 'N/A' else printf('%.2f', v) end as decimales,
         case when v is null then 'N/A' else format('{:,}', cast(trunc(v) as bigint)) end as entero,
         case when v is null then 'N/A' else concat(cast(trunc(v) as bigint), ' días') end as dias,
         case when v is null then 'N/A' else concat(printf('%.1f', v), ' hrs') end as horas
       from (select o_orderkey, case when o_orderkey % 9 = 0 then null else o_totalprice end as v from orders)""",
)
def number_formats(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fmt(v / 1000, "percentage").alias("porcentaje"),
        fmt(v, "decimal").alias("decimales"),
        fmt(v, "integer").alias("entero"),
        fmt(v, "days").alias("dias"),
        fmt(v, "hours").alias("horas"),
    )


def _cases(name: str, value: str) -> str:
    spec = BANDS[name]
    tests = " ".join(f"when {value} {spec.op} {limit:e} then '{label}'" for limit, label in spec.limits)
    missing = f"when {value} is null then '{spec.missing}'" if spec.missing else ""
    return f"case {missing} {tests} else '{spec.otherwise}' end as {name}"


_SHARES = ("fr30", "fr30_live", "anomaly", "anomaly_rule", "anomaly_live", "badge_risk", "badge_anomaly", "level")
_DAYS = ("state", "rul", "window", "bi", "usage")


@QUERIES.add(
    "F-BAND",
    f"""select l_orderkey, l_linenumber, {', '.join(_cases(n, 's') for n in _SHARES)},
          {', '.join(_cases(n, 'd') for n in _DAYS)},
          case when d < 7 then 'CRÍTICA' when d < 21 then 'ALTA' when d / 2 < 45 then 'MEDIA' else 'BAJA' end as urgencia
        from (select l_orderkey, l_linenumber, case when l_orderkey % 20 = 0 then null else l_quantity / 50 end as s,
                l_quantity * 2 as d from lineitem)""",
)
def band_sets(spark, sf_dir):
    share = F.when(F.col("l_orderkey") % 20 != 0, F.col("l_quantity") / 50)
    days = F.col("l_quantity") * 2
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *[band(share, n).alias(n) for n in _SHARES],
        *[band(days, n).alias(n) for n in _DAYS],
        urgency(days / 2, days).alias("urgencia"),
    )


@QUERIES.add("IO09", sql(f"select '2001-07' as mes, {_KPI_SQL.replace('codigo,', 'codigo as equipo,', 1)} from kpis", "kpis"))
def csv_export(spark, sf_dir):
    """The flat export written and read back."""
    path = scratch_folder(spark, "kpis")
    rows = rule_kpis(spark, sf_dir)
    exports.export_kpis(rows, path, "csv", "2001-07")
    schema = exports.kpi_rows(rows, "2001-07").schema
    # empty bands come back as null
    back = spark.read.schema(schema).option("header", True).csv(path).fillna("")
    return _kpi_columns(back, "equipo").withColumn("mes", F.lit("2001-07"))


@QUERIES.add(
    "IO10",
    sql(
        """select '2001-07' as mes, codigo as equipo, round(fr30_risk, 6) as risk_30d, fr30_banda as banda,
             round(rul50_d, 6) as rul50_d, round(forecast_30d_h, 6) as forecast_30d_h,
             round(anomaly_score, 6) as anomaly_score from kpis""",
        "kpis",
    ),
)
def json_export(spark, sf_dir):
    """The nested export written and read back."""
    path = scratch_folder(spark, "kpis")
    rows = rule_kpis(spark, sf_dir)
    exports.export_kpis(rows, path, "json", "2001-07")
    back = spark.read.schema(exports.kpi_documents(rows, "2001-07").schema).json(path)
    return back.select(
        "mes", "equipo", F.round("kpis.fr30.risk_30d", 6).alias("risk_30d"), F.col("kpis.fr30.banda").alias("banda"),
        F.round("kpis.rul.rul50_d", 6).alias("rul50_d"),
        F.round("kpis.forecast.forecast_30d_h", 6).alias("forecast_30d_h"),
        F.round("kpis.anomaly.anomaly_score", 6).alias("anomaly_score"),
    )


@QUERIES.add(
    "IO11",
    sql(
        """select codigo, count(*) as total_ingresos, round(median(tbf_dias), 6) as tbf_promedio,
             round(median(mttr_horas), 6) as mttr_promedio from tl group by 1""",
        "tl",
    ),
)
def processed_export(spark, sf_dir):
    """The processed log and its summary written; the summary read back."""
    folder = scratch_folder(spark, "processed")
    exports.export_processed(timeline(spark, sf_dir), folder)
    back = spark.read.parquet(f"{folder}/resumen_equipos")
    return back.select("codigo", "total_ingresos", r("tbf_promedio"), r("mttr_promedio"))


@QUERIES.add(
    "IO12",
    sql(
        """select codigo as equipo, fr30_risk, fn as fr30_nivel, f.c as fr30_color, f.p as fr30_prioridad,
             round(rul50_d, 6) as rul50_d, round(rul90_d, 6) as rul90_d, round(forecast_7d_h, 6) as forecast_7d_h,
             round(forecast_30d_h, 6) as forecast_30d_h, round(anomaly_score, 6) as anomaly_score, an as anomaly_nivel,
             a.c as anomaly_color, (select count(*) from kpis) as total_records
           from (select *, case when fr30_risk >= 5e-1 then 'ALTO' when fr30_risk >= 3e-1 then 'MEDIO' else 'BAJO' end as fn,
                   case when anomaly_score >= 8e-1 then 'ALTO' when anomaly_score >= 6e-1 then 'MEDIO' else 'BAJO' end as an
                 from kpis)
           join (values ('ALTO', '#DC3545', 3), ('MEDIO', '#FFC107', 2), ('BAJO', '#28A745', 1)) f(b, c, p) on f.b = fn
           join (values ('ALTO', '#DC3545'), ('MEDIO', '#FFC107'), ('BAJO', '#28A745')) a(b, c) on a.b = an""",
        "kpis",
    ),
)
def bi_export(spark, sf_dir):
    rows = kpi.bi_flat(rule_kpis(spark, sf_dir))
    numbers = ("rul50_d", "rul90_d", "forecast_7d_h", "forecast_30d_h", "anomaly_score")
    return rows.withColumns({c: F.round(c, 6) for c in numbers})
