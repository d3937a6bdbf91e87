"""Scans of visit logs and telemetry."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ALIASES, TELEMETRY, VISITS
from .shape import clean_names, drop_empty_rows, map_columns, sanitize_columns

_CANONICAL = {name: [a.lower() for a in [name, *aliases]] for name, aliases in ALIASES.items()}
_LOWER = {name.lower(): aliases for name, aliases in _CANONICAL.items()}


def read_visits(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """A visit log under canonical lower-case names.

    Parquet is read with the given or its own schema. CSV is read as text without an inference
    pass, in three attempts from strict to lenient: header on the first line, header below some
    banner lines, no recognisable header. Banner lines have no valid entry date, so cleaning
    drops them; ``clean.parse_dates`` turns the texts into timestamps. Each file is read by its own
    header; a column that a file lacks is null there.
    """
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        # empty rows are left to cleaning: looking for them would read every column
        return _canonical(reader.parquet(path))
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    if schema is not None:
        strict = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        return _canonical(drop_empty_rows(strict.csv(path)))
    parts = [_read_csv(spark, files) for files in _layouts(spark, path)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _layouts(spark: SparkSession, path: str) -> list[str | list[str]]:
    """Files by header line, which is their first line with a machine-code title.

    One row for each layout comes to the driver, with the names of its files, which Spark's file
    list holds there anyway.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"),
    )
    plain = F.translate(F.lower(F.col("value")), ' -"', "__")  # quotes go
    cells = F.transform(F.split(plain, ","), lambda c: F.trim(c, F.lit("_")))
    titles = F.array(*[F.lit(name) for name in dict.fromkeys(_LOWER["codigo"])])
    titled = F.arrays_overlap(cells, titles)
    headers = lines.groupBy("file").agg(F.min_by(F.when(titled, F.col("value")), F.when(titled, F.col("at"))).alias("header"))
    found = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if len(found) < 2:
        return [path]
    return [[unquote(file) for file in row.files] for row in sorted(found, key=lambda row: row.files)]


def _read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    with_header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if _has_code(with_header.columns):
        return _canonical(drop_empty_rows(with_header))
    bare = spark.read.option("header", False).option("inferSchema", False).csv(path)
    header = _find_header(bare)
    if header is None:
        return sanitize_columns(drop_empty_rows(bare))
    names = [h if h else c for h, c in zip(header, bare.columns)]
    titled = bare.toDF(*clean_names(names))
    is_header = reduce(
        lambda a, b: a & b, [bare[c].eqNullSafe(F.lit(h)) for c, h in zip(bare.columns, header)]
    )
    body = bare.filter(~is_header).toDF(*titled.columns)
    return _canonical(drop_empty_rows(body))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).parquet(path)


def _has_code(names: list[str]) -> bool:
    return any(n in _LOWER["codigo"] for n in clean_names(names))


def _find_header(bare: DataFrame) -> list[str | None] | None:
    """The first line with a machine-code title; one row comes back."""
    cells = F.array(*[F.upper(F.trim(F.col(c))) for c in bare.columns])
    titles = F.array(*[F.lit(a) for a in ALIASES["CODIGO"]])
    found = bare.filter(F.arrays_overlap(cells, titles)).limit(1).collect()
    return list(found[0]) if found else None


def _canonical(df: DataFrame) -> DataFrame:
    """Clean names first, then aliases: a sheet says ``FECHA IN``, the aliases ``fecha_in``."""
    return map_columns(sanitize_columns(df), _LOWER)


def typed_visits(df: DataFrame) -> DataFrame:
    """Cast to the canonical types where the columns exist; what does not fit becomes null."""
    kinds = {f.name: f.dataType for f in VISITS.fields}
    return df.withColumns(
        {
            c: F.col(c).try_cast(kinds[c])
            for c in df.columns
            if c in kinds and not isinstance(kinds[c], T.TimestampType)
        }
    )
