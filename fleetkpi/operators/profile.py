"""Data profiling: one aggregation pass per table, long-format results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import elapsed_days, instant
from ..sources.shape import detect_code_column, detect_roles
from .clean import valid_code


def summary(timeline: DataFrame) -> DataFrame:
    """Rows, machines, period, systems, fleets, classes, mean TBF and repair hours."""
    distinct = {
        "equipos_unicos": "codigo",
        "sistemas_afectados": "sistema_afectado",
        "flotas": "flota",
        "clases": "clase",
    }
    return timeline.agg(
        F.count("*").alias("total_registros"),
        F.min(F.col("fecha_in").cast("date")).alias("inicio"),
        F.max(F.col("fecha_in").cast("date")).alias("fin"),
        *[F.count_distinct(c).alias(n) for n, c in distinct.items()],
        F.avg("tbf_dias").alias("tbf_promedio"),
        F.avg("ciclo_horas").alias("mttr_promedio"),
    )


def repeated_visits(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier (machine, entry) pair."""
    pairs = df.groupBy("codigo", "fecha_in").agg(F.count("*").alias("_n"))
    return pairs.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicados"))


def quality_report(timeline: DataFrame, as_of: str, columns: Sequence[str]) -> DataFrame:
    """One row per check and per incomplete column, plus the score.

    ``tipo`` is ``duplicados``, ``fechas_futuras``, ``tbf_anomalos``, ``faltante_pct`` or
    ``puntaje``; ``columna`` names the column of a ``faltante_pct`` row.
    """
    tbf = F.col("tbf_dias")
    checks = timeline.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("fecha_in") > instant(as_of)).alias("fechas_futuras"),
        F.count_if((tbf > 365) | (tbf < 0)).alias("tbf_anomalos"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in columns],
    ).crossJoin(F.broadcast(repeated_visits(timeline)))  # one row each
    names = ("duplicados", "fechas_futuras", "tbf_anomalos")
    issues = sum((F.col(n) > 0).cast("int") for n in names)
    entries = [
        *[(n, F.lit(""), F.col(n).cast("double")) for n in names],
        ("puntaje", F.lit(""), F.greatest(F.lit(0), F.lit(100) - issues * 10).cast("double")),
        *[("faltante_pct", F.lit(c), F.try_divide(F.col(f"_m_{c}"), F.col("n")) * 100) for c in columns],
    ]
    rows = F.array(
        *[F.struct(F.lit(t).alias("tipo"), c.alias("columna"), v.alias("valor")) for t, c, v in entries]
    )
    long = checks.select(F.explode(rows).alias("_e")).select("_e.*")
    return long.filter((F.col("tipo") != "faltante_pct") | (F.col("valor") > 0))


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, filled, empty and distinct counts and a sample (the least value) per column.

    Exact distinct counts of many columns shuffle every column's values; ``exact=False`` keeps
    a sketch per column instead.
    """
    total = F.count("*")
    distinct = F.count_distinct if exact else F.approx_count_distinct
    stats = df.agg(
        *[
            F.struct(
                F.lit(name).alias("columna"),
                F.lit(kind).alias("tipo"),
                F.count(name).alias("no_nulos"),
                (total - F.count(name)).alias("nulos"),
                distinct(F.col(name)).alias("distintos"),
                F.min(F.col(name)).cast("string").alias("ejemplo"),
            ).alias(name)
            for name, kind in df.dtypes
        ]
    )
    return stats.select(F.explode(F.array(*df.columns)).alias("_e")).select("_e.*")


def role_columns(df: DataFrame) -> DataFrame:
    """Columns found per role by name, with their distinct counts."""
    roles = detect_roles(df)
    pairs = [(role, c) for role, found in roles.items() for c in found]
    columns = sorted({c for _, c in pairs})
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(r).alias("rol"), F.lit(c).alias("columna"), F.col(c).alias("valores_unicos"))
        for r, c in pairs
    ]
    return counts.select(F.explode(F.array(*rows)).alias("_e")).select("_e.*")


def completeness(df: DataFrame, key_columns: Sequence[str] = ()) -> DataFrame:
    """Share of filled cells, complete rows, and completeness of the key columns."""
    filled = sum((F.count(c) for c in df.columns), F.lit(0))
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    total = F.count("*")
    return df.agg(
        (F.try_divide(filled, total * len(df.columns)) * 100).alias("completitud_pct"),
        F.count_if(complete).alias("filas_completas"),
        (F.try_divide(F.count_if(complete), total) * 100).alias("filas_completas_pct"),
        *[(F.try_divide(F.count(c), total) * 100).alias(f"{c}_pct") for c in key_columns],
    )


def date_span(df: DataFrame, column: str) -> DataFrame:
    days = elapsed_days(F.max(column), F.min(column))
    return df.agg(
        F.min(F.col(column).cast("date")).alias("desde"),
        F.max(F.col(column).cast("date")).alias("hasta"),
        days.alias("dias"),
        (days / 365.25).alias("anios"),
        F.count(column).alias("validos"),
    )


def rows_by_year(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.year(column).alias("anio"))
        .agg(F.count("*").alias("registros"))
    )


def visits_distribution(df: DataFrame) -> DataFrame:
    """Distribution of visits over machines."""
    per_machine = df.groupBy("codigo").agg(F.count("*").alias("n"))
    return per_machine.agg(
        F.count("*").alias("equipos"),
        F.avg("n").alias("promedio"),
        F.percentile("n", F.lit(0.5)).alias("mediana"),
        F.min("n").alias("minimo"),
        F.max("n").alias("maximo"),
    )


def enough_history(df: DataFrame, minimum: float = 10) -> DataFrame:
    per_machine = F.try_divide(F.count("*"), F.count_distinct("codigo"))
    return df.agg(
        F.count_distinct("codigo").alias("equipos"),
        F.count("*").alias("registros"),
        per_machine.alias("registros_por_equipo"),
        (per_machine >= minimum).alias("suficiente"),
    )


def quick_stats(df: DataFrame, code_column: str | None = None, shown: int = 10) -> DataFrame:
    """Rows, columns, valid machines and the first few codes in order."""
    key = code_column or detect_code_column(df)
    codes = (
        df.filter(valid_code(key))
        .groupBy(F.col(key).cast("string").alias("codigo"))
        .agg(F.lit(1).alias("_one"))
    )
    head = codes.orderBy("codigo").limit(shown)
    listed = head.agg(F.array_join(F.sort_array(F.collect_list("codigo")), ", ").alias("primeros"))
    return (
        df.agg(F.count("*").alias("total_registros"))
        .withColumn("columnas_total", F.lit(len(df.columns)))
        .withColumn("codigo_column", F.lit(key))
        .crossJoin(F.broadcast(codes.agg(F.count("*").alias("equipos_unicos"))))
        .crossJoin(F.broadcast(listed))
    )

