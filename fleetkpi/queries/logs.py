"""Reading, header handling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, profile
from ..schema import EXPECTED_ATTENTION, EXPECTED_SYSTEMS
from ..sources import shape
from ..sources.adapters import AS_OF, MIN_DATE, table, telemetry_from_lineitem
from ..sources.readers import read_telemetry, read_visits, typed_visits
from ..storage import scratch_folder
from .base import Registry, big, cleaned, r, raw, sql, timeline, ts

QUERIES = Registry()

_TS = "'%Y-%m-%d %H:%M:%S'"


@QUERIES.add(
    "IO01 IO05",
    sql(
        f"""select visit_id, codigo, strftime(fecha_in, {_TS}) as fecha_in,
              strftime(fecha_out, {_TS}) as fecha_out, trim(sistema_afectado) as sistema, mttr_horas
            from visits""",
        "visits",
    ),
)
def scan_csv_log(spark, sf_dir):
    """The log as a site sheet in CSV, read back through the reader."""
    path = scratch_folder(spark, "sheet")
    raw(spark, sf_dir).select(
        "visit_id",
        F.col("codigo").alias("EQUIPO"),
        F.date_format("fecha_in", "yyyy-MM-dd HH:mm:ss").alias("FECHA IN"),
        F.date_format("fecha_out", "yyyy-MM-dd HH:mm:ss").alias("Fecha-Out"),
        F.trim("sistema_afectado").alias("SISTEMA"),
        F.col("mttr_horas").alias("mttr_horas"),
    ).write.option("header", True).csv(path)
    log = typed_visits(clean.parse_dates(read_visits(spark, path, "csv"), "fecha_in", "fecha_out"))
    return log.select(
        "visit_id", "codigo", ts("fecha_in"), ts("fecha_out"),
        F.col("sistema_afectado").alias("sistema"), "mttr_horas",
    )


@QUERIES.add(
    "IO01",
    sql(
        f"""select equipo, strftime(fecha, '%Y-%m-%d') as fecha, temperatura,
              round(vibracion, 6) as vibracion, ciclos_trabajo from tb""",
        "tb",
    ),
)
def scan_telemetry(spark, sf_dir):
    path = scratch_folder(spark, "telemetry")
    telemetry_from_lineitem(spark, sf_dir).write.parquet(path)
    return read_telemetry(spark, path).select(
        "equipo", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "temperatura",
        r("vibracion"), "ciclos_trabajo",
    )


@QUERIES.add("IO02", "select l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem")
def columns_by_position(spark, sf_dir):
    return shape.select_positions(table(spark, sf_dir, "lineitem"), 1, 5)


def _gappy(spark, sf_dir):
    """Orders with every tenth row emptied and every third status missing."""
    empty, third = F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") % 3 == 0
    return table(spark, sf_dir, "orders").select(
        F.when(~empty, F.col("o_orderkey")).alias("o_orderkey"),
        F.when(~empty, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(~empty & ~third, F.col("o_orderstatus")).alias("o_orderstatus"),
    )


_GAPPY = """
  select case when o_orderkey % 10 <> 0 then o_orderkey end as o_orderkey,
    case when o_orderkey % 10 <> 0 then o_totalprice end as o_totalprice,
    case when o_orderkey % 10 <> 0 and o_orderkey % 3 <> 0 then o_orderstatus end as o_orderstatus
  from orders"""


@QUERIES.add(
    "IO03",
    sql(
        """select * from g where o_orderkey is not null or o_totalprice is not null
             or o_orderstatus is not null""",
        g=_GAPPY,
    ),
)
def drop_empty_rows(spark, sf_dir):
    return shape.drop_empty_rows(_gappy(spark, sf_dir))


@QUERIES.add(
    "IO04",
    """select o_orderkey as orden_no, o_custkey as orden_no_1, o_orderstatus as unnamed_col,
         o_orderpriority as año_prioridad from orders""",
)
def sanitize_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    return shape.sanitize_columns(orders.toDF("Orden No.", "_orden-no", "%%", "Año Prioridad"))


@QUERIES.add(
    "IO05",
    """select o_orderkey as "CODIGO", cast(o_orderdate as date) as "FECHA_IN",
         o_orderpriority as "SISTEMA_AFECTADO", o_orderstatus as "CLASE", o_custkey as "COD"
       from orders""",
)
def alias_mapping(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("CODIGO"),
        F.col("o_orderdate").cast("date").alias("INGRESO"),
        F.col("o_orderpriority").alias("SISTEMA"),
        F.col("o_orderstatus").alias("TIPO"),
        F.col("o_custkey").alias("COD"),
    )
    return shape.map_columns(orders)


@QUERIES.add(
    "IO06",
    sql(
        f"""select codigo as codigo_equipo, strftime(fecha_in, {_TS}) as fecha_ingreso,
              sistema_afectado, mttr_horas, flota, cast(null as varchar) as placa,
              cast(null as varchar) as operador
            from visits""",
        "visits",
    ),
)
def canonical_projection(spark, sf_dir):
    sheet = raw(spark, sf_dir).select(
        F.col("codigo").alias("CODIGO"),
        F.date_format("fecha_in", "yyyy-MM-dd HH:mm:ss").alias("FECHA IN"),
        F.col("sistema_afectado").alias("SISTEMA AFECTADO"),
        F.col("mttr_horas").alias("MTTR"),
        F.col("flota").alias("FLOTA"),
    )
    return shape.to_canonical(sheet).select(
        "codigo_equipo", "fecha_ingreso", "sistema_afectado", "mttr_horas", "flota", "placa", "operador"
    )


@QUERIES.add(
    "IO07",
    sql(
        """select 'clave' as columna, count(distinct codigo) as codigos from visits""",
        "visits",
    ),
)
def detect_code_column(spark, sf_dir):
    """No name matches, so the first column's values decide."""
    log = raw(spark, sf_dir).select(F.col("codigo").alias("clave"), F.col("fecha_in").alias("momento"))
    found = shape.detect_code_column(log)
    return log.agg(F.lit(found).alias("columna"), F.count_distinct(found).alias("codigos"))


@QUERIES.add(
    "IO08",
    sql(
        """select rol, columna, valores_unicos from (
             select 'codigo_equipo' as rol, 'codigo' as columna, count(distinct codigo) as valores_unicos from visits
             union all select 'codigo_equipo', 'visit_id', count(distinct visit_id) from visits
             union all select 'fecha_ingreso', 'fecha_in', count(distinct fecha_in) from visits
             union all select 'fecha_ingreso', 'fecha_out', count(distinct fecha_out) from visits
             union all select 'fecha_salida', 'fecha_out', count(distinct fecha_out) from visits
             union all select 'sistema', 'sistema_afectado', count(distinct sistema_afectado) from visits
             union all select 'sistema', 'tipo_atencion', count(distinct tipo_atencion) from visits
             union all select 'tiempo', 'mttr_horas', count(distinct mttr_horas) from visits)""",
        "visits",
    ),
)
def detect_column_roles(spark, sf_dir):
    return profile.role_columns(raw(spark, sf_dir))


# ---------------------------------------------------------------- cleaning


@QUERIES.add(
    "C01 C02",
    f"""select o_orderkey, strftime(try_cast(t as timestamp), {_TS}) as fecha from (
          select o_orderkey, case when o_orderkey % 7 = 0 then 'sin fecha'
                   when o_orderkey % 11 = 0 then '' else strftime(o_orderdate, {_TS}) end as t
          from orders) where try_cast(t as timestamp) is not null""",
)
def parse_dates(spark, sf_dir):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 7 == 0, "sin fecha")
        .when(key % 11 == 0, "")
        .otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("fecha"))
    return clean.drop_undated(clean.parse_dates(orders, "fecha"), "fecha").select("o_orderkey", ts("fecha"))


@QUERIES.add(
    "C03",
    """select o_orderkey, upper(trim(c)) as codigo from (
         select o_orderkey, case when o_orderkey % 5 = 0 then ' nan ' when o_orderkey % 7 = 0 then '  '
                  when o_orderkey % 11 = 0 then null else concat(' eq-', cast(o_custkey as varchar), ' ') end as c
         from orders) where c is not null and upper(trim(c)) not in ('', 'NAN')""",
)
def clean_codes(spark, sf_dir):
    key = F.col("o_orderkey")
    code = (
        F.when(key % 5 == 0, " nan ")
        .when(key % 7 == 0, "  ")
        .when(key % 11 == 0, F.lit(None))
        .otherwise(F.concat(F.lit(" eq-"), F.col("o_custkey").cast("string"), F.lit(" ")))
    )
    return clean.clean_codes(table(spark, sf_dir, "orders").select("o_orderkey", code.alias("codigo")))


@QUERIES.add(
    "C04",
    sql(
        """select visit_id, upper(trim(coalesce(sistema_afectado, 'NO_ESPECIFICADO'))) as sistema_afectado,
             'GENERAL' as flota, 'EQUIPO_GENERAL' as clase from visits""",
        "visits",
    ),
)
def fill_defaults(spark, sf_dir):
    return clean.fill_defaults(raw(spark, sf_dir).select("visit_id", "sistema_afectado"))


@QUERIES.add(
    "C02 C03 C04 C05 C06 C15",
    sql(
        f"""select visit_id, codigo, strftime(fecha_in, {_TS}) as fecha_in,
              strftime(fecha_out, {_TS}) as fecha_out, sistema_afectado, tipo_atencion, mttr_horas,
              flota, clase from clean order by codigo, fecha_in, visit_id""",
        "clean",
    ),
)
def clean_visits(spark, sf_dir):
    rows = clean.sort_visits(cleaned(spark, sf_dir))
    return rows.select(
        "visit_id", "codigo", ts("fecha_in"), ts("fecha_out"), "sistema_afectado", "tipo_atencion",
        "mttr_horas", "flota", "clase",
    )


@QUERIES.add(
    "C05",
    sql(
        f"""select visit_id, codigo from visits
            where fecha_in between timestamp '{MIN_DATE}' and timestamp '{AS_OF}'""",
        "visits",
    ),
)
def entry_date_range(spark, sf_dir):
    return clean.within_dates(raw(spark, sf_dir), MIN_DATE, AS_OF).select("visit_id", "codigo")


@QUERIES.add(
    "C06", sql("select visit_id, codigo from visits where fecha_out is null or fecha_out >= fecha_in", "visits")
)
def exit_after_entry(spark, sf_dir):
    return clean.exits_after_entry(raw(spark, sf_dir)).select("visit_id", "codigo")


@QUERIES.add(
    "C07",
    sql(
        """select visit_id, codigo, tbf_dias, mttr_horas from tl
           where tbf_dias between 0 and 60 and mttr_horas between 0 and 90""",
        "tl",
    ),
)
def outlier_trim(spark, sf_dir):
    """Limits low enough to bite on this log; a null measure drops the row."""
    return clean.validate_ranges(timeline(spark, sf_dir), 60, 90).select(
        "visit_id", "codigo", "tbf_dias", "mttr_horas"
    )


@QUERIES.add(
    "C08",
    sql(
        """select visit_id, trim(upper(sistema_afectado)) as sistema_afectado,
             trim(upper(tipo_atencion)) as tipo_atencion from visits""",
        "visits",
    ),
)
def normalise_texts(spark, sf_dir):
    return clean.normalise_texts(raw(spark, sf_dir)).select("visit_id", "sistema_afectado", "tipo_atencion")


@QUERIES.add(
    "C09",
    sql(
        """select visit_id, codigo from clean where fecha_in >= timestamp '1998-03-01'
             and fecha_in < timestamp '1998-04-01'""",
        "clean",
    ),
)
def month_slice(spark, sf_dir):
    return clean.slice_month(cleaned(spark, sf_dir), "1998-03").select("visit_id", "codigo")


@QUERIES.add("C10", sql("select visit_id, codigo from clean where month(fecha_in) = 7", "clean"))
def month_of_year_slice(spark, sf_dir):
    return clean.slice_month_of_year(cleaned(spark, sf_dir), 7, "fecha_in").select("visit_id", "codigo")


@QUERIES.add(
    "C11",
    sql(
        """select distinct codigo from visits where contains(codigo, '-') and length(codigo) >= 5
             and codigo <> 'nan' order by codigo limit 50""",
        "visits",
    ),
)
def valid_codes(spark, sf_dir):
    return clean.valid_codes(raw(spark, sf_dir), 50)


@QUERIES.add(
    "C12",
    sql(
        """select visit_id, codigo from clean
           where date_trunc('month', fecha_in) = (select max(date_trunc('month', fecha_in)) from clean)""",
        "clean",
    ),
)
def latest_month_fallback(spark, sf_dir):
    """The requested month lies outside the log, so its last month is used."""
    return clean.latest_month_if_empty(cleaned(spark, sf_dir), "2024-12").select("visit_id", "codigo")


@QUERIES.add(
    "C13",
    sql(
        """select visit_id, tbf_dias, ciclo_horas from tl
           where tbf_dias > 0 and tbf_dias < 365 and ciclo_horas > 0 and ciclo_horas < 200""",
        "tl",
    ),
)
def chart_subsets(spark, sf_dir):
    rows = clean.chart_mttr(clean.chart_tbf(timeline(spark, sf_dir)))
    return rows.select("visit_id", "tbf_dias", "ciclo_horas")


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


@QUERIES.add(
    "C14",
    sql(
        f"""select 'sistema_afectado' as columna, trim(upper(sistema_afectado)) as valor, count(*) as filas
            from clean where trim(upper(sistema_afectado)) not in ({_in(EXPECTED_SYSTEMS)}) group by 2
            union all
            select 'tipo_atencion', trim(upper(tipo_atencion)), count(*)
            from clean where trim(upper(tipo_atencion)) not in ({_in(EXPECTED_ATTENTION)}) group by 2""",
        "clean",
    ),
)
def domain_violations(spark, sf_dir):
    return clean.domain_violations(cleaned(spark, sf_dir)).select("columna", "valor", big("filas"))
