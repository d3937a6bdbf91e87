"""Exports of indicator tables, processed logs and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boosted_trees import BoostedTrees
from ..operators.forest import IsolationForest
from ..operators.regression_forest import RegressionForest
from ..operators.reports import machine_summary
from ..plans.fr30 import Fold, ReturnModel

CSV_COLUMNS = [
    "mes",
    "equipo",
    "fr30_risk",
    "fr30_banda",
    "rul50_d",
    "rul90_d",
    "forecast_7d_h",
    "forecast_30d_h",
    "horas_por_dia",
    "anomaly_score",
    "anomaly_banda",
]


def kpi_rows(kpis: DataFrame, month: str) -> DataFrame:
    """The flat export: one row per month and machine."""
    return kpis.withColumn("mes", F.lit(month)).withColumnRenamed("codigo", "equipo").select(CSV_COLUMNS)


def kpi_documents(kpis: DataFrame, month: str) -> DataFrame:
    """One nested document per machine."""
    nested = F.struct(
        F.struct(F.col("fr30_risk").alias("risk_30d"), F.col("fr30_banda").alias("banda")).alias("fr30"),
        F.struct("rul50_d", "rul90_d").alias("rul"),
        F.struct("forecast_7d_h", "forecast_30d_h", "horas_por_dia").alias("forecast"),
        F.struct("anomaly_score", F.col("anomaly_banda").alias("banda")).alias("anomaly"),
    )
    return kpis.select(F.lit(month).alias("mes"), F.col("codigo").alias("equipo"), nested.alias("kpis"))


def export_kpis(kpis: DataFrame, path: str, fmt: str, month: str) -> None:
    """Partitioned files written by the executors; nothing passes through the driver."""
    if fmt == "csv":
        kpi_rows(kpis, month).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        kpi_documents(kpis, month).write.mode("overwrite").json(path)
    elif fmt == "parquet":
        kpi_rows(kpis, month).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def export_processed(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The processed log, and a summary per machine computed from what was written."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("header", True).format(fmt).save(f"{folder}/datos_procesados")
    written = spark.read.schema(df.schema).option("header", True).format(fmt)
    summary = machine_summary(written.load(f"{folder}/datos_procesados"))
    summary.write.mode("overwrite").option("header", True).format(fmt).save(f"{folder}/resumen_equipos")


def save_model(model, path: str, spark: SparkSession) -> None:
    """Keep a fitted model: a parameter table, an ML pipeline, a return model or a forest."""
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(path)
    elif isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    elif isinstance(model, (IsolationForest, RegressionForest)):
        model.save(spark, path)
    elif isinstance(model, ReturnModel):
        model.encoder.write().overwrite().save(f"{path}/encoder")
        for i, fold in enumerate(model.folds):
            fold.classifier.save(spark, f"{path}/fold{i}/classifier")
            fold.calibration.write().overwrite().save(f"{path}/fold{i}/calibration")
        spark.createDataFrame([(len(model.folds),)], "folds int").write.mode("overwrite").parquet(
            f"{path}/meta"
        )
    else:
        raise TypeError(f"cannot save {type(model).__name__}")


def load_model(kind: str, path: str, spark: SparkSession):
    """Load what ``save_model`` wrote; ``kind`` is table, pipeline, forest, regression or return."""
    if kind == "table":
        return spark.read.parquet(path)
    if kind == "pipeline":
        return PipelineModel.load(path)
    if kind == "forest":
        return IsolationForest.load(spark, path)
    if kind == "regression":
        return RegressionForest.load(spark, path)
    if kind == "return":
        folds = spark.read.parquet(f"{path}/meta").first()["folds"]
        return ReturnModel(
            PipelineModel.load(f"{path}/encoder"),
            [
                Fold(
                    BoostedTrees.load(spark, f"{path}/fold{i}/classifier"),
                    IsotonicRegressionModel.load(f"{path}/fold{i}/calibration"),
                )
                for i in range(folds)
            ],
        )
    raise ValueError(f"unknown kind {kind!r}")
