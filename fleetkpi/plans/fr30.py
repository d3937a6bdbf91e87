"""FR-30: probability that a machine is back in the workshop within 30 days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from ..operators.boosted_trees import BoostedTrees, fit_boosted_trees, predict
from ..operators.features import (
    calendar_parts,
    label_next_visit,
    latest_per_machine,
    system_counts,
    tbf_ratio,
)
from ..operators.machine_stats import machine_stats
from ..operators.timeline import NO_CUTS, Cuts, settled
from ..storage import materialise

NUMERIC = [
    "tbf_dias",
    "dias_desde_ultima_salida",
    "ingresos_30d",
    "ingresos_60d",
    "ingresos_90d",
    "sistema_count_60d",
    "mttr_eq",
    "mes",
    "dia_semana",
    "hora_ingreso",
    "tbf_med_60d",
    "tbf_std_60d",
    "tbf_ratio",
]
CATEGORIES = ["flota", "clase"]
FEATURES = NUMERIC + CATEGORIES
CODED = NUMERIC + [f"{c}_cod" for c in CATEGORIES]
MIN_TRAINING_ROWS = 10
#: What the training set and the current state take from a visit.
_USED = [
    "codigo",
    "fecha_in",
    "visit_id",
    "fecha_out",
    "siguiente_in",
    "flota",
    "clase",
    "mes",
    "dia_semana",
    "hora_ingreso",
    "tbf_dias",
    "dias_desde_ultima_salida",
    "ingresos_30d",
    "ingresos_60d",
    "ingresos_90d",
    "sistema_count_60d",
    "mttr_eq",
    "tbf_med_60d",
    "tbf_std_60d",
]


def rule_risk_value() -> Column:
    """Risk from the visits in the 30 days up to the machine's last one, raised for short TBF."""
    n = F.col("n_30d")
    base = F.when(n >= 3, 0.7).when(n == 2, 0.4).when(n == 1, 0.2).otherwise(0.1)
    return F.when(F.col("tbf_media") < 15, F.least(F.lit(0.9), base * 1.5)).otherwise(base)


def rule_risk(stats: DataFrame) -> DataFrame:
    """The rule's risk of every machine; ``stats`` comes from ``machine_stats``."""
    return stats.withColumn("risk_30d", rule_risk_value()).select(
        "codigo",
        "risk_30d",
        band(F.col("risk_30d"), "fr30").alias("banda"),
        F.col("n_30d").alias("ingresos_30d"),
        F.coalesce("tbf_media", F.lit(0.0)).alias("tbf_promedio"),
    )


def _windowed(timeline: DataFrame, cuts: Cuts) -> DataFrame:
    windows = {"ingresos_30d": 30, "ingresos_60d": 60, "ingresos_90d": 90}
    return calendar_parts(system_counts(settled(timeline, cuts), 60, windows, cuts))


def training_set(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Closed cycles with their label ``y`` and the fifteen features."""
    return _closed(_windowed(timeline, cuts))


def _closed(windowed: DataFrame) -> DataFrame:
    rows = label_next_visit(windowed)
    tbf = F.coalesce("tbf_dias", F.lit(0.0))

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    median = F.coalesce(F.col("tbf_med_60d"), tbf)
    return rows.select(
        "codigo",
        "fecha_in",
        "visit_id",
        "y",
        tbf.alias("tbf_dias"),
        F.coalesce("dias_desde_ultima_salida", F.lit(0.0)).alias("dias_desde_ultima_salida"),
        *[zero(c) for c in ("ingresos_30d", "ingresos_60d", "ingresos_90d", "sistema_count_60d")],
        F.coalesce("mttr_eq", F.lit(24.0)).alias("mttr_eq"),
        F.coalesce("flota", F.lit("UNKNOWN")).alias("flota"),
        F.coalesce("clase", F.lit("UNKNOWN")).alias("clase"),
        "mes",
        "dia_semana",
        "hora_ingreso",
        median.alias("tbf_med_60d"),
        F.coalesce("tbf_std_60d", F.lit(0.0)).alias("tbf_std_60d"),
        tbf_ratio(tbf, median).alias("tbf_ratio"),
    )


def current_state(timeline: DataFrame, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Features of every machine's last visit; here a mean repair time of 0 counts as unknown."""
    return _latest(_windowed(timeline, cuts))


def _latest(windowed: DataFrame) -> DataFrame:
    rows = latest_per_machine(windowed)

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    def named(name: str) -> Column:
        return F.when(F.col(name).isNull() | (F.col(name) == ""), "GENERAL").otherwise(
            F.col(name)
        )

    tbf = F.coalesce("tbf_dias", F.lit(0.0))
    median = F.coalesce("tbf_med_60d", F.lit(0.0))
    mttr = F.col("mttr_eq")
    return rows.select(
        "codigo",
        "fecha_in",
        tbf.alias("tbf_dias"),
        F.coalesce("dias_desde_ultima_salida", F.lit(0.0)).alias("dias_desde_ultima_salida"),
        *[filled(c) for c in ("ingresos_30d", "ingresos_60d", "ingresos_90d", "sistema_count_60d")],
        F.when(mttr.isNull() | (mttr == 0), F.lit(24.0)).otherwise(mttr).alias("mttr_eq"),
        named("flota").alias("flota"),
        named("clase").alias("clase"),
        "mes",
        "dia_semana",
        "hora_ingreso",
        median.alias("tbf_med_60d"),
        F.coalesce("tbf_std_60d", F.lit(0.0)).alias("tbf_std_60d"),
        tbf_ratio(tbf, median).alias("tbf_ratio"),
    )


# ---------------------------------------------------------------- trained model


@dataclass
class Fold:
    """A boosted classifier and the calibration fitted on the period after its training rows."""

    classifier: BoostedTrees
    calibration: IsotonicRegressionModel


@dataclass
class ReturnModel:
    encoder: PipelineModel
    folds: list[Fold]


def encode(training: DataFrame) -> PipelineModel:
    """Index fleet and class (new values get their own code) and make the codes plain numbers.

    The index tables are the distinct fleets and classes, which the site's catalogue bounds.
    """
    indexers = [
        StringIndexer(
            inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc"
        )
        for c in CATEGORIES
    ]
    # adding 0 drops the category marks: codes are ordered numbers, however many there are
    plain = ", ".join(f"{c}_idx + 0 as {c}_cod" for c in CATEGORIES)
    codes = SQLTransformer(statement=f"select *, {plain} from __THIS__")
    return Pipeline(stages=[*indexers, codes]).fit(training)


def fit(
    training: DataFrame,
    folds: int = 3,
    iterations: int = 100,
    depth: int = 6,
) -> ReturnModel | None:
    """Boosted trees calibrated over expanding time folds; None where nothing can be trained.

    Folds are cut by entry date. A fold whose training or calibration rows all carry one label
    is skipped.
    """
    encoder = encode(training)
    rows = materialise(
        encoder.transform(training).select(*CODED, F.col("y").cast("double").alias("y"), "fecha_in")
    )
    if rows.limit(MIN_TRAINING_ROWS).count() < MIN_TRAINING_ROWS:
        return None
    at = F.unix_micros("fecha_in")
    cuts = [(i + 1) / (folds + 1) for i in range(folds)]
    edges = rows.agg(F.percentile_approx(at, cuts, 10_000).alias("e")).first()["e"]
    after = [at > edge for edge in edges]
    train = [at <= edge for edge in edges]
    held = [after[i] if i + 1 == folds else after[i] & train[i + 1] for i in range(folds)]
    labels = rows.agg(
        *[
            (F.max(F.when(part, F.col("y"))) > F.min(F.when(part, F.col("y")))).alias(f"{name}{i}")
            for name, parts in (("train", train), ("held", held))
            for i, part in enumerate(parts)
        ]
    ).first()
    usable = [i for i in range(folds) if labels[f"train{i}"] and labels[f"held{i}"]]
    models = fit_boosted_trees(
        rows, CODED, "y", {i: train[i] for i in usable}, iterations=iterations, depth=depth, rate=0.1, least=20
    )
    fitted = []
    for i, classifier in models.items():
        # equal scores first become one weighted point: at most 100,001 points whatever the log
        points = (
            predict(rows.filter(held[i]), classifier, "raw_risk")
            .groupBy(F.round("raw_risk", 5).alias("raw_risk"))
            .agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("n"))
        )
        calibration = IsotonicRegression(
            featuresCol="raw_risk", labelCol="y", weightCol="n"
        ).fit(points)
        fitted.append(Fold(classifier, calibration))
    return ReturnModel(encoder, fitted) if fitted else None


def score(model: ReturnModel, state: DataFrame) -> DataFrame:
    """Mean calibrated probability over the folds, with the band."""
    rows = model.encoder.transform(state)
    parts = []
    for i, fold in enumerate(model.folds):
        scored = predict(rows, fold.classifier, "raw_risk")
        scored = fold.calibration.setPredictionCol(f"_risk{i}").transform(scored)
        parts.append(f"_risk{i}")
        rows = scored.drop("raw_risk")
    total = sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts)
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return (
        rows.withColumn("risk_30d", risk)
        .withColumn("banda", band(F.col("risk_30d"), "fr30"))
        .select("codigo", "risk_30d", "banda", *FEATURES)
    )


def risk(
    timeline: DataFrame, cuts: Cuts = NO_CUTS, **options
) -> DataFrame:
    """Trained risk where the log allows training, rule-based risk elsewhere.

    The windows are run once: training set and current state are taken from what is written.
    """
    windowed = materialise(_windowed(timeline, cuts).select(*_USED))
    model = fit(_closed(windowed), **options)
    if model is None:
        return rule_risk(machine_stats(timeline)).select("codigo", "risk_30d", "banda")
    return score(model, _latest(windowed)).select(
        "codigo", "risk_30d", "banda"
    )
