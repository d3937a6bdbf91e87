"""Continuous versions of the cleaning, alert and count jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..storage import scratch_folder

LATENESS = "2 days"


def clean_stream(visits: DataFrame, min_date: str, as_of: str, lateness: str = LATENESS) -> DataFrame:
    """Valid visits, repeats of (machine, entry) dropped while they may still arrive.

    State holds the pairs within the lateness only.
    """
    code = F.upper(F.trim(F.col("codigo")))
    ts = F.col("fecha_in")
    return (
        visits.withColumn("codigo", code)
        .filter(ts.between(F.lit(min_date).cast("timestamp"), F.lit(as_of).cast("timestamp")))
        .filter(~F.col("codigo").isin("", "NAN"))
        .withWatermark("fecha_in", lateness)
        .dropDuplicatesWithinWatermark(["codigo", "fecha_in"])
    )


def alert_stream(visits: DataFrame, minimum: int = 3, lateness: str = LATENESS) -> DataFrame:
    """Machines with at least ``minimum`` visits in a 30-day window that slides by a day."""
    return (
        visits.withWatermark("fecha_in", lateness)
        .groupBy("codigo", F.window("fecha_in", "30 days", "1 day").alias("ventana"))
        .agg(F.count("*").alias("ingresos"))
        .filter(F.col("ingresos") >= minimum)
        .select(
            "codigo",
            F.col("ventana.start").alias("desde"),
            F.col("ventana.end").alias("hasta"),
            "ingresos",
        )
    )


def tumbling_stream(visits: DataFrame, every: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Visits and mean repair hours per tumbling window."""
    return (
        visits.withWatermark("fecha_in", lateness)
        .groupBy(F.window("fecha_in", every).alias("ventana"))
        .agg(F.count("*").alias("ingresos"), F.avg("mttr_horas").alias("mttr_promedio"))
        .select(F.col("ventana.start").alias("desde"), "ingresos", "mttr_promedio")
    )


def read_events(
    spark: SparkSession, path: str, schema: T.StructType, files: int | None = None
) -> DataFrame:
    """Replay a table, one file or a folder of part files, as a stream.

    All files go into one batch, so that no row is late; with ``files`` so many go into each, and rows
    of files that overlap in time by more than the lateness are late (``run_to_end`` says so).
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # a pattern, since a stream takes a folder or a pattern but not a single file
    return reader.parquet(f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path)


def _dropped(query: StreamingQuery, seen: set[int]) -> int:
    """Rows dropped by the watermark in batches not looked at before."""
    fresh = [p for p in query.recentProgress if p.batchId not in seen]
    seen.update(p.batchId for p in fresh)
    return sum(s.numRowsDroppedByWatermark for p in fresh for s in p.stateOperators)


def run_to_end(
    spark: SparkSession,
    stream: DataFrame,
    keys: Sequence[str],
    mode: str = "update",
    allow_late: bool = False,
    provider: str | None = None,
) -> DataFrame:
    """Process everything available and return the latest row of every key.

    ``provider`` names the state store of this query, where it needs another than the session's.

    Rows that came too late for the watermark are an error unless ``allow_late``.

    Each batch goes to its own folder, overwritten when a batch is retried, so a restart writes
    nothing twice.
    """
    folder = scratch_folder(spark, "stream")
    target = f"{folder}/out"

    kind = T.StructType([*stream.schema.fields, T.StructField("lote", T.LongType())])
    # the folder exists even if nothing arrives
    spark.createDataFrame([], kind).write.partitionBy("lote").parquet(target)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/lote={batch_id}")

    setting = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, provider or usual)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/state")
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        # a query keeps the settings it was started with
        spark.conf.set(setting, usual)
    dropped = 0
    seen: set[int] = set()
    while not query.awaitTermination(1):
        dropped += _dropped(query, seen)
    dropped += _dropped(query, seen)
    if dropped and not allow_late:
        raise ValueError(f"{dropped} rows came later than the watermark allows")
    names = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(kind).parquet(target)
    if not names:
        return rows.select(*keys).distinct()
    last = F.max_by(F.struct(*names), "lote").alias("_l")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col("_l")[n].alias(n) for n in names])


