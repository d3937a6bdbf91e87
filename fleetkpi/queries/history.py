"""Indicators at the end of every month, and the trends read off them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..plans import history
from ..sources.adapters import AS_OF
from .base import Registry, r, sql, timeline_and_cuts

QUERIES = Registry()

_NUMBERS = ("fr30_risk", "rul50_d", "rul90_d", "forecast_7d_h", "forecast_30d_h", "horas_por_dia", "anomaly_score")


def _label(name: str, up: str = "creciente", down: str = "decreciente") -> str:
    now, before = f"round({name}, 9)", f"lag(round({name}, 9)) over (order by mes)"
    change = f"case when {before} <> 0 then ({now} - {before}) / abs({before}) end"
    return f"case when {change} > 5e-2 then '{up}' when {change} < -5e-2 then '{down}' when {change} is not null then 'estable' end"


MONTHS = f"""select *, {_label("promedio_fr30")} as fr30_trend, {_label("promedio_rul50", "mejorando", "empeorando")} as rul_trend,
    {_label("total_horas_pronosticadas_30d")} as usage_trend, {_label("promedio_anomalia")} as anomaly_trend
  from (select mes, count(*) as equipos, avg(fr30_risk) as promedio_fr30, avg(rul50_d) as promedio_rul50,
          sum(forecast_30d_h) as total_horas_pronosticadas_30d, avg(anomaly_score) as promedio_anomalia,
          count(*) filter (con_visita and anomaly_score >= 6e-1) as anomalias_detectadas_mes
        from hist group by mes)"""


@QUERIES.add(
    "A25 A31",
    sql(
        "select codigo, mes, con_visita, anomaly_banda, "
        + ", ".join(f"round({c}, 6) as {c}" for c in _NUMBERS)
        + " from hist",
        "hist",
    ),
)
def indicator_history(spark, sf_dir):
    """The four indicators of every machine at the end of every month."""
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    found = history.indicator_history(rows, AS_OF, cuts)
    return found.select("codigo", "mes", "con_visita", "anomaly_banda", *[r(c) for c in _NUMBERS])


@QUERIES.add(
    "A25 A31",
    sql(
        """select mes, equipos, round(promedio_fr30, 12) as promedio_fr30, round(promedio_rul50, 12) as promedio_rul50,
             round(total_horas_pronosticadas_30d, 4) as total_horas_pronosticadas_30d,
             round(promedio_anomalia, 12) as promedio_anomalia, anomalias_detectadas_mes,
             fr30_trend, rul_trend, usage_trend, anomaly_trend from months""",
        "hist",
        months=MONTHS,
    ),
)
def monthly_indicators(spark, sf_dir):
    """Fleet means, anomalies and trends of every month."""
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    found = history.month_summary(history.indicator_history(rows, AS_OF, cuts))
    digits = {"promedio_fr30": 12, "promedio_rul50": 12, "total_horas_pronosticadas_30d": 4, "promedio_anomalia": 12}
    return found.withColumns({c: F.round(c, n) for c, n in digits.items()})


_DAYS = {n: str(datetime.fromisoformat(AS_OF) - timedelta(days=n)) for n in (0, 7, 14, 30)}


def _change(days: int) -> str:
    change = f"(r0 - r{days}) / abs(r{days})"
    return f"case when {change} > 5e-2 then 'creciente' when {change} < -5e-2 then 'decreciente' when r{days} is not null then 'estable' end"


@QUERIES.add(
    "A31 M06",
    sql(
        f"""select codigo, round(r0, 6) as risk_30d, {_change(7)} as trend_7d, {_change(30)} as trend_30d,
             concat_ws(' ', case when r14 is not null then '{_DAYS[14][:10]}=' || printf('%.2f', r14) end,
               case when r7 is not null then '{_DAYS[7][:10]}=' || printf('%.2f', r7) end,
               '{_DAYS[0][:10]}=' || printf('%.2f', r0)) as historical_risks
           from (select codigo, """
        + ", ".join(f"max(risk) filter (d = {n}) as r{n}" for n in _DAYS)
        + """ from risks group by codigo)""",
        "tl",
        dates=" union all ".join(f"select {n} as d, timestamp '{day}' as t" for n, day in _DAYS.items()),
        seen="select d, tl.*, max(fecha_in) over (partition by d, codigo) as u from dates join tl on fecha_in <= t",
        risks="""select d, codigo, case when tm < 15 then least(9e-1, b * 15e-1) else b end as risk
          from (select d, codigo, tm, case when n >= 3 then 7e-1 when n = 2 then 4e-1 when n = 1 then 2e-1 else 1e-1 end as b
                from (select d, codigo, avg(tbf_dias) as tm, count(*) filter (fecha_in >= u - interval '30' day) as n
                      from seen group by d, codigo))""",
    ),
)
def risk_trends(spark, sf_dir):
    """Return risk now and its trends over 7 and 30 days."""
    rows, cuts = timeline_and_cuts(spark, sf_dir)
    found = history.risk_trends(rows, AS_OF, cuts)
    steps = F.transform("historical_risks", lambda s: F.concat(s["fecha"], F.lit("="), F.format_string("%.2f", s["risk"])))
    return found.select("codigo", r("risk_30d"), "trend_7d", "trend_30d", F.concat_ws(" ", steps).alias("historical_risks"))
