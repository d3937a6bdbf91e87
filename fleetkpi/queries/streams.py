"""Streaming jobs replayed over the events table until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapters import as_visit_events, table
from ..streaming.state import PROVIDER, keyed_alerts
from ..streaming.visits import alert_stream, clean_stream, read_events, run_to_end, tumbling_stream
from .base import Registry, r, sql, ts

QUERIES = Registry()


def _visits(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return as_visit_events(read_events(spark, f"{sf_dir}/events.parquet", schema))


@QUERIES.add(
    "ST1",
    sql("select distinct codigo, strftime(fecha_in, '%Y-%m-%d %H:%M:%S.%f') as fecha_in from ev", "ev"),
)
def stream_clean_visits(spark, sf_dir):
    stream = clean_stream(_visits(spark, sf_dir), "2020-01-01", "2030-01-01")
    rows = run_to_end(spark, stream.select("codigo", "fecha_in"), ["codigo", "fecha_in"], "append")
    return rows.select("codigo", F.date_format("fecha_in", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fecha_in"))


_ALERTS = sql(
    """select codigo, strftime(d, '%Y-%m-%d %H:%M:%S') as desde,
         strftime(d + interval '30' day, '%Y-%m-%d %H:%M:%S') as hasta, count(*) as ingresos
       from (select codigo, date_trunc('day', fecha_in) - cast(i as int) * interval '1' day as d
             from ev cross join (select unnest(range(30)) as i)) group by 1, 2, 3 having count(*) >= 3""",
    "ev",
)


@QUERIES.add("ST2", _ALERTS)
def stream_alerts_keyed(spark, sf_dir):
    """The same alerts from one list of visits a machine."""
    rows = run_to_end(spark, keyed_alerts(_visits(spark, sf_dir)), ["codigo", "desde"], provider=PROVIDER)
    return rows.select("codigo", ts("desde"), ts("hasta"), "ingresos")


@QUERIES.add("ST2", _ALERTS)
def stream_alerts(spark, sf_dir):
    rows = run_to_end(spark, alert_stream(_visits(spark, sf_dir)), ["codigo", "desde"])
    return rows.select("codigo", ts("desde"), ts("hasta"), "ingresos")


@QUERIES.add(
    "ST3",
    sql(
        """select strftime(date_trunc('day', fecha_in), '%Y-%m-%d %H:%M:%S') as desde, count(*) as ingresos,
             round(avg(mttr_horas), 6) as mttr_promedio from ev group by 1""",
        "ev",
    ),
)
def stream_daily_counts(spark, sf_dir):
    rows = run_to_end(spark, tumbling_stream(_visits(spark, sf_dir)), ["desde"])
    return rows.select(ts("desde"), "ingresos", r("mttr_promedio"))
