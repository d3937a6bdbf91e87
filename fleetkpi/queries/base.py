"""Registered queries: a DataFrame job, the survey entries it covers and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_visits
from ..operators.features import visit_timeline
from ..operators.timeline import Cuts, dealt, find_cuts
from ..sources.adapters import AS_OF, MIN_DATE, visits_from_orders

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    covers: tuple[str, ...]
    sql: str | None = None


class Registry(dict[str, Query]):
    def add(self, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
        """Register the function below under its own name."""

        def register(run: Run) -> Run:
            self[run.__name__] = Query(run, tuple(covers.split()), sql)
            return run

        return register


# ---------------------------------------------------------------- inputs of the queries


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits_from_orders(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_visits(raw(spark, sf_dir), MIN_DATE, AS_OF)


def cleaned_and_cuts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Cuts]:
    """The log for windows that start from it; with cuts they deal it themselves."""
    visits = cleaned(spark, sf_dir)
    cuts = find_cuts(visits)
    return visits if cuts else dealt(visits, cuts), cuts


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_and_cuts(spark, sf_dir)[0]


def timeline_and_cuts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Cuts]:
    visits = cleaned(spark, sf_dir)
    cuts = find_cuts(visits)
    return visit_timeline(visits, AS_OF, cuts), cuts


# ---------------------------------------------------------------- output shape


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded under its own name, so that summation order does not show."""
    name = column if isinstance(column, str) else None
    value = F.round(F.col(column) if name else column, digits)
    return value.alias(name) if name else value


def ts(name: str) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(name)


def joined(name: str) -> Column:
    return F.array_join(F.col(name), " | ").alias(name)


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# ---------------------------------------------------------------- shared SQL

CTES = {
    "o": """
      select *, cast(floor(o_custkey / 5) as bigint) as m,
             o_orderdate + (o_orderkey % 24) * interval '1' hour as fi
      from orders""",
    "visits": """
      select o_orderkey as visit_id,
        concat(case m % 4 when 0 then 'VD' when 1 then 'CG' when 2 then 'EX' else 'CV' end,
               '-EQ', lpad(cast(m as varchar), 5, '0')) as codigo,
        fi as fecha_in,
        case when o_orderkey % 17 = 0 then null
             when o_orderkey % 41 = 0 then fi - interval '5' hour
             else fi + (1 + o_orderkey % 96) * interval '1' hour end as fecha_out,
        case when o_orderkey % 29 = 0 then null
             else concat(' ', lower(substr(o_orderpriority, 3))) end as sistema_afectado,
        case o_orderstatus when 'P' then 'CORRECTIVA' when 'O' then 'PREVENTIVA'
             else 'ALISTAMIENTO-TC' end as tipo_atencion,
        case when o_orderkey % 13 = 0 then null
             else cast(1 + o_orderkey % 96 as double) end as mttr_horas,
        n_name as flota, c_mktsegment as clase
      from o join customer on c_custkey = m * 5 join nation on n_nationkey = c_nationkey""",
    "clean": f"""
      select visit_id, upper(trim(codigo)) as codigo, fecha_in, fecha_out,
        upper(trim(coalesce(sistema_afectado, 'NO_ESPECIFICADO'))) as sistema_afectado,
        tipo_atencion, mttr_horas, flota, clase
      from visits
      where fecha_in between timestamp '{MIN_DATE}' and timestamp '{AS_OF}'
        and (fecha_out is null or fecha_out >= fecha_in)
        and upper(trim(codigo)) not in ('', 'NAN')""",
    "tl": f"""
      select *,
        floor((epoch_us(fecha_in) - epoch_us(lag(fecha_in) over w)) / 86400000000e0) as tbf_dias,
        lag(fecha_in) over w as anterior_in,
        lead(fecha_in) over w as siguiente_in,
        coalesce((epoch_us(fecha_out) - epoch_us(fecha_in)) / 3600000000e0, 24e0) as ciclo_horas,
        floor((epoch_us(timestamp '{AS_OF}') - epoch_us(coalesce(fecha_out, fecha_in)))
              / 86400000000e0) as dias_desde_ultima_salida,
        row_number() over w as rn,
        count(*) over p as n_visitas,
        min(fecha_in) over p as primera_in,
        max(fecha_in) over p as ultima_in
      from clean
      window w as (partition by codigo order by fecha_in, visit_id), p as (partition by codigo)""",
    "wf": """
      select *,
        avg(ciclo_horas) over (partition by codigo) as mttr_eq,
        quantile_cont(tbf_dias, 5e-1) over (s rows between 4 preceding and current row) as tbf_med_60d,
        coalesce(stddev_samp(tbf_dias) over (s rows between 4 preceding and current row), 0e0)
          as tbf_std_60d,
        quantile_cont(ciclo_horas, 5e-1) over (s rows between 9 preceding and current row)
          as mttr_med_90d,
        count(*) over (t range between 2591999999999 preceding and current row) as ingresos_30d,
        count(*) over (t range between 5183999999999 preceding and current row) as ingresos_60d,
        count(*) over (t range between 7775999999999 preceding and current row) as ingresos_90d,
        count(distinct sistema_afectado)
          over (t range between 5183999999999 preceding and current row) as sistemas_unicos_60d,
        count(*) over (partition by codigo, sistema_afectado order by epoch_us(fecha_in)
                       range between 5183999999999 preceding and current row) as sistema_count_60d
      from tl
      window s as (partition by codigo order by fecha_in, visit_id),
             t as (partition by codigo order by epoch_us(fecha_in))""",
    "last": """
      select * from (select *, row_number() over (partition by codigo
                       order by fecha_in desc, visit_id desc) as rd from tl) where rd = 1""",
    "lastwf": """
      select * from (select *, row_number() over (partition by codigo
                       order by fecha_in desc, visit_id desc) as rd from wf) where rd = 1""",
    # rule-based indicators
    "fr30": """
      select codigo, risk_30d, ingresos_30d, coalesce(tbf, 0e0) as tbf_promedio,
        case when risk_30d >= 5e-1 then '🔴 ALTO (≥50%)'
             when risk_30d >= 3e-1 then '🟠 MEDIO (30-49%)' else '🟢 BAJO (<30%)' end as banda
      from (select *, case when tbf < 15 then least(9e-1, base * 15e-1) else base end as risk_30d
            from (select *, case when ingresos_30d >= 3 then 7e-1 when ingresos_30d = 2 then 4e-1
                                 when ingresos_30d = 1 then 2e-1 else 1e-1 end as base
                  from (select codigo, avg(tbf_dias) as tbf,
                          count(*) filter (fecha_in >= ultima_in - interval '30' day) as ingresos_30d
                        from tl group by codigo)))""",
    "rul": f"""
      select codigo, greatest(1e0, base * 7e-1 - edad * 5e-1) as rul50_d,
        greatest(1e0, base * 9e-1 - edad * 3e-1) as rul90_d, edad as edad_actual_d, clase,
        'SIMPLE' as modelo_usado, base as tbf_base
      from (select a.codigo,
              case when own > 0 then own when fleet > 0 then fleet else 30e0 end as base,
              floor((epoch_us(timestamp '{AS_OF}') - epoch_us(l.fecha_in)) / 86400000000e0) as edad,
              l.clase
            from (select codigo, median(tbf_dias) as own from tl group by codigo) a
            join last l on l.codigo = a.codigo
            cross join (select median(tbf_dias) as fleet from tl))""",
    "forecast": """
      select codigo, hpd * 7 as forecast_7d_h, hpd * 30 as forecast_30d_h, hpd as horas_por_dia,
        'SIMPLE' as modelo_usado, 'fallback' as tipo_modelo, 'BAJA' as confianza,
        factor as factor_actividad
      from (select codigo, factor,
              (case when own > 0 then own when fleet > 0 then fleet else 8e0 end) * factor as hpd
            from (select codigo, avg(ciclo_horas) as own,
                    least(2e0, greatest(1e-1, count(*) filter
                      (fecha_in >= ultima_in - interval '30' day) / 30e0 * 7)) as factor
                  from tl group by codigo)
            cross join (select avg(ciclo_horas) as fleet from tl))""",
    "anomaly": """
      select codigo, least(1e0, s) as anomaly_score,
        case when s >= 6e-1 then '🔴 ALTO (≥60%)' when s >= 4e-1 then '🟠 MEDIO (40-59%)'
             else '🟢 BAJO (<40%)' end as banda,
        rec as ingresos_recientes, prom as ingresos_promedio, coalesce(tbf3, 0e0) as tbf_reciente,
        sis as sistemas_recientes
      from (select *,
              (case when rec > prom * 2 then 4e-1 else 0e0 end)
              + (case when tbf3 < tbf * 5e-1 then 3e-1 else 0e0 end)
              + (case when sis > 2 then 2e-1 else 0e0 end)
              + (case when hrec > h * 15e-1 then 1e-1 else 0e0 end) as s
            from (select codigo,
                    count(*) filter (fecha_in >= ultima_in - interval '30' day) as rec,
                    count(*) / greatest(1e0, floor((epoch_us(max(fecha_in)) - epoch_us(min(fecha_in)))
                                                   / 86400000000e0) / 30) as prom,
                    median(tbf_dias) as tbf, median(ciclo_horas) as h,
                    median(ciclo_horas) filter (fecha_in >= ultima_in - interval '30' day) as hrec,
                    median(tbf_dias) filter (rn > n_visitas - 3) as tbf3,
                    count(distinct sistema_afectado)
                      filter (fecha_in >= ultima_in - interval '30' day) as sis
                  from tl group by codigo))""",
    "kpis": """
      select codigo, coalesce(f.risk_30d, 0e0) as fr30_risk, coalesce(f.banda, '') as fr30_banda,
        coalesce(r.rul50_d, 0e0) as rul50_d, coalesce(r.rul90_d, 0e0) as rul90_d,
        coalesce(p.forecast_7d_h, 0e0) as forecast_7d_h,
        coalesce(p.forecast_30d_h, 0e0) as forecast_30d_h,
        coalesce(p.horas_por_dia, 0e0) as horas_por_dia,
        coalesce(a.anomaly_score, 0e0) as anomaly_score, coalesce(a.banda, '') as anomaly_banda
      from fr30 f full join rul r using (codigo) full join forecast p using (codigo)
        full join anomaly a using (codigo)""",
    # the rules recomputed at the end of every month, over all visits up to it
    "hist": f"""
      with dates as (select strftime(m, '%Y-%m') as mes, least(m + interval 1 month, timestamp '{AS_OF}') as t
                  from (select unnest(range(date_trunc('month', timestamp '{MIN_DATE}'), timestamp '{AS_OF}', interval 1 month)) as m)),
      h as (select mes, t, codigo, fecha_in, tbf_dias, ciclo_horas, sistema_afectado,
              max(fecha_in) over (partition by mes, codigo) as u,
              row_number() over (partition by mes, codigo order by fecha_in desc, visit_id desc) as rd
            from dates join tl on fecha_in < t or t = timestamp '{AS_OF}'),
      fl as (select mes, median(tbf_dias) as ft, avg(ciclo_horas) as fh from h group by mes),
      s as (select mes, codigo, any_value(t) as t, count(*) as n, max(fecha_in) as u,
              count(*) filter (fecha_in >= u - interval '30' day) as n30, avg(tbf_dias) as tm, median(tbf_dias) as tmed,
              avg(ciclo_horas) as hm, median(ciclo_horas) as hmed,
              median(ciclo_horas) filter (fecha_in >= u - interval '30' day) as h30, median(tbf_dias) filter (rd <= 3) as t3,
              count(distinct sistema_afectado) filter (fecha_in >= u - interval '30' day) as s30,
              floor((epoch_us(max(fecha_in)) - epoch_us(min(fecha_in))) / 86400000000e0) as activo
            from h group by mes, codigo),
      x as (select s.*, strftime(u, '%Y-%m') = s.mes as con_visita,
              case when n30 >= 3 then 7e-1 when n30 = 2 then 4e-1 when n30 = 1 then 2e-1 else 1e-1 end as rb,
              case when tmed > 0 then tmed when ft > 0 then ft else 30e0 end as base,
              floor((epoch_us(t) - epoch_us(u)) / 86400000000e0) as edad,
              (case when hm > 0 then hm when fh > 0 then fh else 8e0 end) * least(2e0, greatest(1e-1, n30 / 30e0 * 7)) as hpd,
              (case when n30 > n / greatest(1e0, activo / 30) * 2 then 4e-1 else 0e0 end)
              + (case when t3 < tmed * 5e-1 then 3e-1 else 0e0 end) + (case when s30 > 2 then 2e-1 else 0e0 end)
              + (case when h30 > hmed * 15e-1 then 1e-1 else 0e0 end) as score
            from s join fl using (mes))
      select codigo, mes, con_visita, case when tm < 15 then least(9e-1, rb * 15e-1) else rb end as fr30_risk,
        greatest(1e0, base * 7e-1 - edad * 5e-1) as rul50_d, greatest(1e0, base * 9e-1 - edad * 3e-1) as rul90_d,
        hpd * 7 as forecast_7d_h, hpd * 30 as forecast_30d_h, hpd as horas_por_dia, least(1e0, score) as anomaly_score,
        case when score >= 6e-1 then '🔴 ALTO (≥60%)' when score >= 4e-1 then '🟠 MEDIO (40-59%)' else '🟢 BAJO (<40%)' end
          as anomaly_banda
      from x""",
    # telemetry
    "tb": """
      select concat(case l_suppkey % 9 when 0 then 'VD' when 1 then 'CG' when 2 then 'EX'
                      when 3 then 'CV' when 4 then 'NE' when 5 then 'RE' when 6 then 'AH'
                      when 7 then 'PE' else 'TI' end,
                    '-S', lpad(cast(l_suppkey as varchar), 5, '0')) as equipo,
        l_shipdate as fecha, 55 + l_quantity as temperatura,
        100 * l_tax + 10 * l_discount as vibracion,
        cast(4 + 2 * l_linenumber as double) as horas_operacion,
        cast(100 + l_partkey % 101 as bigint) as ciclos_trabajo,
        cast(dayofyear(l_shipdate) as int) as dia_anio
      from lineitem""",
    "telemetry": """
      select *, 1 + dia_anio / 365e0 * 3e-1 as degradacion,
        least(1e0, (vibracion * (1 + dia_anio / 365e0 * 3e-1) + horas_operacion * 1e-1
                    + greatest(0e0, temperatura - 80) * 5e-2) / 100) as prob_falla_30d,
        greatest(1e1, 365 - dia_anio - vibracion * 10 - greatest(0e0, temperatura - 85) * 2)
          as rul_estimado
      from tb""",
    "ev": """
      select concat('EV-', cast(user_id as varchar)) as codigo, ts as fecha_in,
        event_type as sistema_afectado, value as mttr_horas
      from events""",
}

_NEEDS = {
    "visits": ["o"],
    "clean": ["visits"],
    "tl": ["clean"],
    "wf": ["tl"],
    "last": ["tl"],
    "lastwf": ["wf"],
    "fr30": ["tl"],
    "rul": ["tl", "last"],
    "forecast": ["tl"],
    "anomaly": ["tl"],
    "kpis": ["fr30", "rul", "forecast", "anomaly"],
    "hist": ["tl"],
    "telemetry": ["tb"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """A statement with the named shared tables, then any ``extra`` ones, in front of it."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            want(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        want(name)
    parts = [f"{name} as ({CTES[name]})" for name in wanted]
    parts += [f"{name} as ({text})" for name, text in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
