"""Views of the order tables as a visit log and as machine telemetry.

The order tables stand in for a site's own log in tests, in the bench and in the registered
queries: five customers form one machine, an order is a workshop visit, a line item is a
telemetry reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_runtime_settings

AS_OF = "2001-08-02 00:00:00"
MIN_DATE = "1995-06-01 00:00:00"
TELEMETRY_AS_OF = "2001-12-01"


# declared, so that reading a table starts no job to look at file footers
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = use_runtime_settings(spark).read.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hours(count) -> F.Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, count.cast("int"), zero, F.lit(0))


def visits_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    machine = F.floor(F.col("o_custkey") / 5).cast("bigint")
    orders = table(spark, sf_dir, "orders").select(
        key.alias("visit_id"),
        machine.alias("m"),
        (F.col("o_orderdate").cast("timestamp") + _hours(key % 24)).alias("fecha_in"),
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
    )
    customer = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey")).alias("c_key"), "c_nationkey", F.col("c_mktsegment").alias("clase")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("flota"))
    owner = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_key", "flota", "clase"
    )
    visit, m = F.col("visit_id"), F.col("m")
    prefix = (
        F.when(m % 4 == 0, "VD").when(m % 4 == 1, "CG").when(m % 4 == 2, "EX").otherwise("CV")
    )
    fecha_in = F.col("fecha_in")
    return orders.join(owner, m * 5 == F.col("c_key")).select(
        visit,
        F.concat(prefix, F.lit("-EQ"), F.lpad(m.cast("string"), 5, "0")).alias("codigo"),
        fecha_in,
        F.when(visit % 17 == 0, F.lit(None).cast("timestamp"))
        .when(visit % 41 == 0, fecha_in - _hours(F.lit(5)))
        .otherwise(fecha_in + _hours(1 + visit % 96))
        .alias("fecha_out"),
        F.when(
            visit % 29 != 0,
            F.concat(F.lit(" "), F.lower(F.substring(F.col("o_orderpriority"), 3, 100))),
        ).alias("sistema_afectado"),
        F.when(F.col("o_orderstatus") == "P", "CORRECTIVA")
        .when(F.col("o_orderstatus") == "O", "PREVENTIVA")
        .otherwise("ALISTAMIENTO-TC")
        .alias("tipo_atencion"),
        F.when(visit % 13 != 0, (1 + visit % 96).cast("double")).alias("mttr_horas"),
        "flota",
        "clase",
    )


def telemetry_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings; the health labels come from ``features.health_labels``."""
    supplier = F.col("l_suppkey")
    kinds = F.array(*[F.lit(k) for k in ("VD", "CG", "EX", "CV", "NE", "RE", "AH", "PE", "TI")])
    return table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.element_at(kinds, (supplier % 9 + 1).cast("int")),
            F.lit("-S"),
            F.lpad(supplier.cast("string"), 5, "0"),
        ).alias("equipo"),
        F.col("l_shipdate").cast("timestamp").alias("fecha"),
        (F.lit(55) + F.col("l_quantity")).alias("temperatura"),
        (F.lit(100) * F.col("l_tax") + F.lit(10) * F.col("l_discount")).alias("vibracion"),
        (F.lit(4) + F.lit(2) * F.col("l_linenumber")).cast("double").alias("horas_operacion"),
        (F.lit(100) + F.col("l_partkey") % 101).cast("bigint").alias("ciclos_trabajo"),
        F.dayofyear("l_shipdate").cast("int").alias("dia_anio"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lectura_id"),
    )


def visit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in visit-log shape, for the streaming jobs."""
    return as_visit_events(table(spark, sf_dir, "events"))


def as_visit_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("EV-"), F.col("user_id").cast("string")).alias("codigo"),
        F.col("ts").cast("timestamp").alias("fecha_in"),
        F.col("event_type").alias("sistema_afectado"),
        F.col("value").alias("mttr_horas"),
    )
