"""Row filters and value repairs on the visit log.

Every predicate is a plain comparison on a column, so a Parquet scan can take it over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant, month_start
from ..schema import (
    DEFAULT_CLASS,
    DEFAULT_FLEET,
    EXPECTED_ATTENTION,
    EXPECTED_SYSTEMS,
    NO_SYSTEM,
)


def date_formats(day_first: bool = True) -> list[str]:
    """Usual ways to write a date, each with and without a time of day."""
    numeric = ["d{s}M{s}yyyy", "M{s}d{s}yyyy"] if day_first else ["M{s}d{s}yyyy", "d{s}M{s}yyyy"]
    days = [f.format(s=s) for f in numeric for s in "/-."]
    days += ["yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy", "d-MMM-yyyy"]
    return [day + time for day in days for time in ("", " H:mm", " H:mm:ss")]


def parse_dates(
    df: DataFrame, *columns: str, formats: Sequence[str] | None = None, day_first: bool = True
) -> DataFrame:
    """Text to timestamps; what does not parse becomes null.

    ISO comes first, then ``formats`` in turn. Where day and month could be either, ``day_first``
    decides which of the usual ones is tried first.
    """
    kinds = dict(df.dtypes)
    usual = date_formats(day_first) if formats is None else formats
    parsed = {
        c: F.coalesce(
            F.try_to_timestamp(F.trim(F.col(c))),
            *[F.try_to_timestamp(F.trim(F.col(c)), F.lit(f)) for f in usual],
        )
        if kinds[c] == "string"
        else F.col(c).cast("timestamp")
        for c in columns
        if c in kinds
    }
    return df.withColumns(parsed) if parsed else df


def drop_undated(df: DataFrame, ts: str = "fecha_in") -> DataFrame:
    return df.dropna(subset=[ts])


def clean_codes(df: DataFrame, key: str = "codigo") -> DataFrame:
    code = F.upper(F.trim(F.col(key).cast("string")))
    return df.withColumn(key, code).filter(
        F.col(key).isNotNull() & ~F.col(key).isin("", "NAN")
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    """System text, and fleet or class where the log has no such column at all."""
    present = set(df.columns)
    system = (
        F.upper(F.trim(F.coalesce(F.col("sistema_afectado").cast("string"), F.lit(NO_SYSTEM))))
        if "sistema_afectado" in present
        else F.lit(NO_SYSTEM)
    )
    filled = {"sistema_afectado": system}
    if "flota" not in present:
        filled["flota"] = F.lit(DEFAULT_FLEET)
    if "clase" not in present:
        filled["clase"] = F.lit(DEFAULT_CLASS)
    return df.withColumns(filled)


def within_dates(df: DataFrame, min_date: str, as_of: str, ts: str = "fecha_in") -> DataFrame:
    return df.filter(F.col(ts).between(instant(min_date), instant(as_of)))


def exits_after_entry(df: DataFrame) -> DataFrame:
    if "fecha_out" not in df.columns:
        return df
    return df.filter(F.col("fecha_out").isNull() | (F.col("fecha_out") >= F.col("fecha_in")))


def clean_visits(df: DataFrame, min_date: str, as_of: str) -> DataFrame:
    """The whole cleaning chain; dates first so that the scan can skip row groups."""
    dated = drop_undated(parse_dates(df, "fecha_in", "fecha_out"))
    ranged = within_dates(dated, min_date, as_of)
    return fill_defaults(clean_codes(exits_after_entry(ranged)))


def validate_ranges(df: DataFrame, max_tbf: float = 730, max_mttr: float = 720) -> DataFrame:
    """Outlier trim; a null measure fails the comparison and the row goes."""
    return df.filter(F.col("tbf_dias").between(0, max_tbf) & F.col("mttr_horas").between(0, max_mttr))


def normalise_texts(df: DataFrame, *columns: str) -> DataFrame:
    names = columns or ("tipo_atencion", "sistema_afectado")
    return df.withColumns({c: F.trim(F.upper(F.col(c))) for c in names if c in df.columns})


def slice_month(df: DataFrame, year_month: str, ts: str = "fecha_in") -> DataFrame:
    """Rows of one 'YYYY-MM' as a half-open range, which prunes row groups and partitions."""
    start = F.lit(f"{year_month}-01").cast("date")
    return df.filter(
        (F.col(ts) >= start.cast("timestamp"))
        & (F.col(ts) < F.add_months(start, 1).cast("timestamp"))
    )


def slice_month_of_year(df: DataFrame, month: int, ts: str = "fecha") -> DataFrame:
    return df.filter(F.month(ts) == month)


def latest_month_if_empty(df: DataFrame, year_month: str, ts: str = "fecha_in") -> DataFrame:
    """The requested month, or the last month with data if the requested one is empty."""
    wanted = F.lit(f"{year_month}-01").cast("date")
    month = month_start(F.col(ts))
    chosen = df.agg(
        F.coalesce(F.max(F.when(month == wanted, month)), F.max(month)).alias("_chosen")
    )
    return (
        df.crossJoin(F.broadcast(chosen))  # one row
        .filter(month == F.col("_chosen"))
        .drop("_chosen")
    )


def valid_code(key: str = "codigo") -> Column:
    """A text that looks like a machine code."""
    code = F.col(key).cast("string")
    return code.contains("-") & (F.length(code) >= 5) & (code != "nan")


def valid_codes(df: DataFrame, limit: int | None = 50, key: str = "codigo") -> DataFrame:
    codes = df.filter(valid_code(key)).select(F.col(key).cast("string").alias(key)).distinct()
    codes = codes.orderBy(key)
    return codes if limit is None else codes.limit(limit)


def chart_tbf(df: DataFrame) -> DataFrame:
    return df.filter((F.col("tbf_dias") > 0) & (F.col("tbf_dias") < 365))


def chart_mttr(df: DataFrame) -> DataFrame:
    return df.filter((F.col("ciclo_horas") > 0) & (F.col("ciclo_horas") < 200))


def domain_violations(df: DataFrame) -> DataFrame:
    """Values outside the expected systems and attention types, with their row counts.

    Counting first keeps the comparison on distinct values, not on rows.
    """

    def offending(column: str, expected: list[str]) -> DataFrame:
        value = F.trim(F.upper(F.col(column)))
        counted = df.groupBy(value.alias("valor")).agg(F.count("*").alias("filas"))
        return counted.filter(F.col("valor").isNotNull() & ~F.col("valor").isin(expected)).select(
            F.lit(column).alias("columna"), "valor", "filas"
        )

    parts = [
        offending("sistema_afectado", EXPECTED_SYSTEMS),
        offending("tipo_atencion", EXPECTED_ATTENTION),
    ]
    return reduce(DataFrame.unionByName, parts)


def sort_visits(df: DataFrame) -> DataFrame:
    return df.orderBy("codigo", "fecha_in", "visit_id")
