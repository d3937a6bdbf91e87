"""Logical tables and the fixed values of the visit-log domain."""

from __future__ import annotations

from pyspark.sql import types as T

VISITS = T.StructType(
    [
        T.StructField("visit_id", T.LongType()),
        T.StructField("codigo", T.StringType()),
        T.StructField("fecha_in", T.TimestampType()),
        T.StructField("fecha_out", T.TimestampType()),
        T.StructField("sistema_afectado", T.StringType()),
        T.StructField("tipo_atencion", T.StringType()),
        T.StructField("mttr_horas", T.DoubleType()),
        T.StructField("flota", T.StringType()),
        T.StructField("clase", T.StringType()),
    ]
)

TELEMETRY = T.StructType(
    [
        T.StructField("equipo", T.StringType()),
        T.StructField("fecha", T.TimestampType()),
        T.StructField("temperatura", T.DoubleType()),
        T.StructField("vibracion", T.DoubleType()),
        T.StructField("horas_operacion", T.DoubleType()),
        T.StructField("ciclos_trabajo", T.LongType()),
        T.StructField("prob_falla_30d", T.DoubleType()),
        T.StructField("rul_estimado", T.DoubleType()),
        T.StructField("dia_anio", T.IntegerType()),
    ]
)

# ---- fixed values: names, domains and factors the results depend on ----

# site sheet header -> canonical name
SITE_COLUMNS = {
    "codigo_equipo": "CODIGO",
    "fecha_ingreso": "FECHA IN",
    "fecha_salida": "FECHA OUT",
    "sistema_afectado": "SISTEMA AFECTADO",
    "tipo_atencion": "TIPO ATENCION",
    "descripcion_intervencion": "DESCRIPCION INTERVENCION",
    "mttr_horas": "MTTR",
    "dias_desde_averia": "Cont.Dias.Ave",
    "horas_desde_averia": "Con.Hrs.Ave",
    "contador_ingresos": "Con.In.Taller",
    "descripcion_equipo": "DESCRIPCION",
    "placa": "PLACA",
    "flota": "FLOTA",
    "operador": "OPERADOR",
    "ejecutor": "EJECUTOR",
    "atencion_local": "ATENCION LOCAL",
    "atencion_externa": "ATENCION EXTERNA",
    "origen_averia": "ORIGEN AVERIA",
}

# canonical name -> accepted headers, first one present wins
ALIASES = {
    "CODIGO": ["CODIGO", "COD", "EQUIPO", "ID_EQUIPO", "EQUIPMENT"],
    "FECHA_IN": ["FECHA_IN", "FECHA_INGRESO", "INGRESO", "DATE_IN", "ENTRADA"],
    "FECHA_OUT": ["FECHA_OUT", "FECHA_SALIDA", "SALIDA", "DATE_OUT", "EGRESO"],
    "SISTEMA_AFECTADO": ["SISTEMA_AFECTADO", "SISTEMA", "SUBSISTEMA", "COMPONENT"],
    "FLOTA": ["FLOTA", "FLEET", "TIPO_FLOTA"],
    "CLASE": ["CLASE", "CLASS", "CATEGORIA", "TIPO"],
}

# role of a column -> keywords looked for in its upper-cased name
ROLE_KEYWORDS = {
    "codigo_equipo": ["CODIGO", "COD", "EQUIPO", "EQUIPMENT", "ID"],
    "fecha_ingreso": ["FECHA", "INGRESO", "ENTRADA", "IN", "INICIO"],
    "fecha_salida": ["SALIDA", "OUT", "FIN", "TERMINO"],
    "sistema": ["SISTEMA", "SYSTEM", "TIPO", "CATEGORIA"],
    "descripcion": ["DESCRIPCION", "DETALLE", "OBSERV", "NOTA"],
    "tiempo": ["TIEMPO", "HORA", "DURACION", "TIME"],
    "estado": ["ESTADO", "STATUS", "CONDICION"],
}
CODE_KEYWORDS = ["codigo", "equipo", "maquina", "id"]

EXPECTED_SYSTEMS = [
    "HIDRÁULICO",
    "MOTOR",
    "VIBRATORIO",
    "AIRE ACONDICIONADO Y CLIMATIZACIÓN",
    "SISTEMA ELÉCTRICO",
    "SISTEMA DE FRENOS",
    "TRANSMISIÓN",
    "DIRECCIÓN",
    "SISTEMA DE ENFRIAMIENTO",
    "CARROCERÍA",
    "COMBUSTIBLE",
    "NEUMÁTICOS",
]
EXPECTED_ATTENTION = ["CORRECTIVA", "PREVENTIVA", "ALISTAMIENTO-TC"]

# machine type -> base temperature, vibration scale, mean hours a day; unknown types use VD
TYPE_FACTORS = {
    "VD": (70.0, 2.0, 12.0),
    "CG": (80.0, 3.0, 10.0),
    "EX": (85.0, 4.0, 14.0),
    "CV": (75.0, 2.5, 8.0),
    "NE": (65.0, 1.5, 6.0),
    "RE": (70.0, 2.0, 10.0),
    "AH": (75.0, 2.8, 12.0),
    "PE": (80.0, 3.2, 10.0),
    "TI": (90.0, 1.8, 16.0),
}
DEFAULT_TYPE = "VD"

NO_SYSTEM = "NO_ESPECIFICADO"
DEFAULT_FLEET = "GENERAL"
DEFAULT_CLASS = "EQUIPO_GENERAL"
DEFAULT_REPAIR_HOURS = 24.0
