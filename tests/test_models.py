from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import SF_DIR
from visitlog import AS_OF, values, visits

from fleetkpi.functions.bands import NO_DATA, band, urgency
from fleetkpi.functions.fmt import exact_round, fixed, fmt
from fleetkpi.operators import features
from fleetkpi.operators.forest import decision, expected_path, fit_forest, score_forest
from fleetkpi.operators.machine_stats import fleet_stats, machine_stats
from fleetkpi.plans import anomaly, forecast, fr30, kpi, rul, survival
from fleetkpi.plans import telemetry as tm
from fleetkpi.queries.base import timeline_and_cuts
from fleetkpi.sources import exports
from pyspark.sql import Window
from pyspark.sql import functions as F


def column(spark, values_, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], "i int, v double")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_band_edges(spark):
    got = column(spark, [0.5, 0.4999, 0.3, 0.2999, None], lambda v: band(v, "fr30"))
    assert got == ["🔴 ALTO (≥50%)", "🟠 MEDIO (30-49%)", "🟠 MEDIO (30-49%)", "🟢 BAJO (<30%)", NO_DATA]
    assert column(spark, [0.8, 0.6, 0.59], lambda v: F.substring(band(v, "anomaly"), 3, 4)) == ["ALTO", "MEDI", "BAJO"]
    assert column(spark, [6.99, 7.0, 21.0], lambda v: band(v, "rul")) == ["CRÍTICO", "ALERTA", "NORMAL"]
    assert column(spark, [70.0, 70.1, 50.0], lambda v: band(v, "state")) == ["ALTO", "CRÍTICO", "MODERADO"]
    assert column(spark, [6.0, 20.0, 21.0, 100.0], lambda v: urgency(v, v)) == ["CRÍTICA", "ALTA", "MEDIA", "BAJA"]


def test_number_texts(spark):
    numbers = [0.5, 1.5, 2.5, 0.125, 0.15, 0.25, 0.35, 2.675, 1234567.891, -3.7, 0.285, 99.95]
    for digits in (0, 1, 2):
        assert column(spark, numbers, lambda v: fixed(v, digits)) == [f"{n:.{digits}f}" for n in numbers]
    for digits in (1, 2, 3):
        assert column(spark, numbers, lambda v: exact_round(v, digits)) == [round(n, digits) for n in numbers]
    assert column(spark, [1234567.8, None], lambda v: fmt(v, "integer")) == ["1,234,567", "N/A"]
    assert column(spark, [0.1234], lambda v: fmt(v, "percentage")) == ["12.3%"]
    assert column(spark, [12.9, 3.26], lambda v: fmt(v, "days")) == ["12 días", "3 días"]


def machine(code, days, start_id=0, **kwargs):
    return [(start_id + i, code, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 00:00:00", *kwargs.values()) for i, d in enumerate(days)]


def test_rule_risk(spark):
    log = visits(spark, machine("A-1", [0]) + machine("B-1", [0, 200, 220], 10) + machine("C-1", [0, 5, 10, 15], 20))
    rows = fr30.rule_risk(machine_stats(features.visit_timeline(log, AS_OF)))
    got = values(rows, "codigo", "risk_30d", "banda")
    assert got["A-1"] == (0.2, "🟢 BAJO (<30%)")
    assert got["B-1"] == (0.4, "🟠 MEDIO (30-49%)")
    assert got["C-1"] == (0.9, "🔴 ALTO (≥50%)")


def test_weibull_recovers_its_parameters(spark):
    rng = np.random.default_rng(3)
    days = np.maximum(1, np.round(60 * rng.weibull(2.0, 4000))).astype(int)
    gaps = spark.createDataFrame(
        [("C1", int(d), f"A-{i:05d}") for i, d in enumerate(days)] + [("C2", 30, "B-1")] * 9 + [("C3", d, "Z-1") for d in (1, 2, 3, 4)],
        "clase string, duration long, codigo string",
    ).withColumn("fecha_evento", F.lit("2024-01-01").cast("timestamp"))
    fitted = values(rul.fit_weibull(gaps), "clase", "lambda", "k")
    # one distinct length has no finite shape, and four intervals are too few
    assert fitted.keys() == {"C1"}
    scale, shape = fitted["C1"]
    x = days.astype(float)
    score = (x**shape * np.log(x)).sum() / (x**shape).sum() - 1 / shape - np.log(x).mean()
    assert abs(score) < 1e-9
    assert scale == pytest.approx((x**shape).mean() ** (1 / shape))
    assert shape == pytest.approx(2.0, rel=0.1)


def test_global_model_where_no_class_has_enough(spark):
    gaps = spark.createDataFrame(
        [(f"C{i}", d, "A-1") for i in range(3) for d in (5, 10 + i, 20)], "clase string, duration long, codigo string"
    ).withColumn("fecha_evento", F.lit("2024-01-01").cast("timestamp"))
    params = rul.fit_weibull(gaps)
    assert [r.clase for r in params.collect()] == ["GLOBAL"]
    latest = spark.createDataFrame([("A-1", "C9")], "codigo string, clase string").withColumn(
        "fecha_in", F.lit("2024-12-01").cast("timestamp")
    )
    row = rul.remaining_life(latest, params, AS_OF).first()
    assert row.modelo_usado == "GLOBAL" and row.edad_actual_d == 30.0
    survive = lambda t: math.exp(-((t / row["lambda"]) ** row.k))
    if 0 < row.rul50_d < 2 * row["lambda"]:
        assert survive(30 + row.rul50_d) / survive(30) == pytest.approx(0.5)


def test_unknown_class_takes_the_first_seen(spark):
    params = spark.createDataFrame(
        [("C2", 50.0, 1.0, 9, 50.0, ("A-1", 2)), ("C1", 40.0, 1.0, 9, 40.0, ("A-1", 3))],
        "clase string, lambda double, k double, n_observaciones long, duracion_media double, aparicion struct<c:string,t:int>",
    )
    latest = spark.createDataFrame([("X", "C1"), ("Y", "C7")], "codigo string, clase string")
    assert values(rul.with_class_parameters(latest, params), "codigo", "modelo_usado") == {"X": "C1", "Y": "C2"}


def test_maintenance_window(spark):
    df = spark.createDataFrame([("A", 10.0, 6.9), ("B", 0.5, 20.9)], "codigo string, rul50_d double, rul90_d double")
    got = values(rul.maintenance_window(df), "codigo", "ventana_optima_inicio", "ventana_optima_fin", "urgencia")
    assert got == {"A": (4, 9, "ALTA"), "B": (14, 0, "MEDIA")}


def test_usage_series_limits(spark):
    log = visits(
        spark,
        machine("A-1", [0, 20]) + machine("B-1", [0, 3, 8], 10) + machine("C-1", [0, 10, 20], 20)
        + [(30 + i, "D-1", f"2024-01-{d:02d} 00:00:00", f"2024-01-{d:02d} 06:00:00") for i, d in enumerate((1, 9, 18))],
    )
    days = forecast.machine_days(features.visit_timeline(log, AS_OF))
    series = forecast.usage_series(days)
    # two visits are too few, nine days too short
    assert {r.codigo for r in series.select("codigo").distinct().collect()} == {"C-1", "D-1"}
    c = [r.y for r in series.filter("codigo = 'C-1'").orderBy("ds").collect()]
    assert len(c) == 21 and c[0] == pytest.approx(24.0, abs=5) and c[5] == 0.0


def test_trends_are_taken_where_the_series_is_made(spark, monkeypatch):
    """One row a machine leaves a task, equal to what its rows give, however machines fall into batches and lots."""
    rng = random.Random(8)
    rows = [(m, m * 3 + rng.randrange(60 + 40 * m), rng.uniform(-2, 30), "C" + str(m % 3)) for m in range(12) for _ in range(1 + 4 * m)]
    days = spark.createDataFrame(rows, "m int, d int, h double, clase string").groupBy(
        F.when(F.col("m") != 7, F.format_string("A-%02d", "m")).alias("codigo"), F.expr("date_add(date'2024-01-01', d)").alias("dia")
    ).agg(F.sum("h").alias("horas"), F.count("*").alias("visitas"), F.max("clase").alias("clase"))
    wide = {r.codigo: r for r in forecast._trend_and_week(forecast.usage_series(days), "codigo").collect()}
    assert len(wide) == 11 and None in wide
    monkeypatch.setattr(forecast.daily, "DAYS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        trends = forecast.usage_trends(days)
        assert "Generate" not in trends._jdf.queryExecution().optimizedPlan().toString()
        got = trends.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(wide)
    for row in got:
        for name in trends.columns:
            if name != "codigo":
                one, two = row[name], wide[row.codigo][name]
                assert one == (pytest.approx(two, rel=1e-9, abs=1e-9) if isinstance(two, float) else two), name


def test_usage_series_is_that_of_windows(spark):
    """Filled, smoothed over three days, capped at the exact 99th percentile; values may be negative."""
    rng = random.Random(4)
    rows = [(f"A-{m}", d, rng.uniform(-5, 20), 1, "C1") for m in range(4) for d in rng.sample(range(90 + 150 * m), 20 + 60 * m)]
    days = spark.createDataFrame(rows, "codigo string, d int, horas double, visitas int, clase string").select(
        "codigo", F.expr("date_add(date'2024-01-01', d)").alias("dia"), "horas", F.col("visitas").cast("bigint").alias("visitas"), "clase"
    )
    machine = Window.partitionBy("codigo")
    span = days.groupBy("codigo").agg(F.min("dia").alias("a"), F.max("dia").alias("b"))
    full = span.select("codigo", F.explode(F.sequence("a", "b")).alias("ds")).join(days.withColumnRenamed("dia", "ds"), ["codigo", "ds"], "left")
    smooth = full.withColumn("y", F.avg(F.coalesce("horas", F.lit(0.0))).over(machine.orderBy("ds").rowsBetween(-2, 0)))
    capped = smooth.withColumn("y", F.least("y", F.percentile("y", F.lit(0.99)).over(machine)))
    want = {(r.codigo, r.ds): r.y for r in capped.collect()}
    got = {(r.codigo, r.ds): r.y for r in forecast.usage_series(days).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)


def test_silent_machine_falls_back_to_its_mean(spark):
    fits = spark.createDataFrame(
        [("A", "individual", 0.0, 0.0, 3.0, "2024-06-01"), ("B", "individual", 0.0, 0.0, 2.0, "2024-12-30")],
        "modelo string, tipo string, pendiente double, dia_medio double, media double, ultimo_dia string",
    ).withColumns({"ultimo_dia": F.col("ultimo_dia").cast("date"), **{f"efecto_{d}": F.lit(0.0) for d in range(7)}})
    got = values(forecast.horizon(fits, AS_OF), "modelo", "forecast_7d_h", "forecast_30d_h", "horas_por_dia")
    assert got["A"] == (0.0, 0.0, 3.0)
    assert got["B"] == (14.0, 58.0, pytest.approx(58 / 30))


def test_class_models_where_machines_have_little(spark):
    rows = [("A", "C1", i) for i in range(12)] + [("B", "C1", i) for i in range(12)] + [("Z", "C2", i) for i in range(12)]
    series = spark.createDataFrame(rows, "codigo string, clase string, i int").select(
        "codigo", "clase", F.expr("date_add(date'2024-01-01', i)").alias("ds"), F.col("i").cast("double").alias("y")
    )
    assert [(r.modelo, r.tipo) for r in forecast.models(series).collect()] == [("CLASE_C1", "clase")]


def test_rule_rul_defaults(spark):
    rows = features.visit_timeline(visits(spark, [(1, "A-1", "2024-12-30 00:00:00")]), AS_OF)
    row = rul.rule_rul(machine_stats(rows), fleet_stats(rows), AS_OF).first()
    assert (row.tbf_base, row.rul50_d, row.rul90_d) == (30.0, 20.5, 26.7)


def test_normalise(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 3.0)], "i int, s double")
    assert values(anomaly.normalise(df, "s"), "i", "normalizado") == {1: 1.0, 2: 0.0, 3: 0.5}
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "i int, s double")
    assert set(values(anomaly.normalise(same, "s"), "i", "normalizado").values()) == {0.0}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(3000)] + [(9999, 14.0, -20.0)]
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_forest_finds_the_planted_outlier(spark, cloud, tmp_path):
    forest = fit_forest(cloud, ["a", "b"], ["id"])
    scored = score_forest(cloud, forest).persist()
    assert scored.orderBy(F.desc("score")).first().id == 9999
    assert scored.agg(F.min("score"), F.max("score")).first()[0] > 0
    share = decision(scored).filter("decision < 0").count() / 3001
    assert share == pytest.approx(0.1, abs=0.01)
    # neither order nor partitioning of the rows matters
    again = fit_forest(cloud.repartition(7).orderBy(F.rand(3)), ["a", "b"], ["id"])
    assert np.allclose(again.mean, forest.mean) and np.allclose(again.scale, forest.scale)
    assert again.nodes.drop(columns="threshold").equals(forest.nodes.drop(columns="threshold"))
    assert np.allclose(again.nodes.threshold, forest.nodes.threshold)
    exports.save_model(forest, str(tmp_path / "forest"), spark)
    loaded = score_forest(cloud, exports.load_model("forest", str(tmp_path / "forest"), spark))
    assert values(loaded, "id", "score") == values(scored, "id", "score")


def test_forest_samples_copies_apart(spark):
    """A third of the rows are copies; no tree takes more than its share of them."""
    rows = [(0.0, 0.0)] * 20_000 + [(float(i % 97), float(i % 89)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    forest = fit_forest(df, ["a", "b"], trees=20)
    sizes = forest.nodes.groupby("tree")["sample"].first()
    assert len(sizes) == 20 and sizes.max() < 400 and sizes.min() > 130


def test_expected_path():
    assert list(expected_path(np.array([1, 2]))) == [0.0, 1.0]
    assert float(expected_path(256)) == pytest.approx(10.2448, abs=1e-3)


@pytest.fixture(scope="module")
def log(spark):
    return timeline_and_cuts(spark, SF_DIR)


def test_trained_return_risk(spark, log, tmp_path):
    rows, cuts = log
    training = fr30.training_set(rows, cuts)
    model = fr30.fit(training, iterations=8, depth=3)
    state = fr30.current_state(rows, cuts)
    # a fleet the model has never seen
    state = state.withColumn("flota", F.when(F.col("codigo").startswith("VD"), "NUEVA").otherwise(F.col("flota")))
    scored = values(fr30.score(model, state), "codigo", "risk_30d")
    assert len(scored) == state.count() and all(0 <= v <= 1 for v in scored.values())
    assert len(set(scored.values())) > 1
    path = str(tmp_path / "model")
    exports.save_model(model, path, spark)
    assert values(fr30.score(exports.load_model("return", path, spark), state), "codigo", "risk_30d") == scored
    for fold in model.folds:
        steps = list(fold.calibration.predictions)
        assert steps == sorted(steps)


def test_trained_risk_runs_the_windows_once(spark, log, monkeypatch):
    rows, cuts = log
    expected = fr30.score(fr30.fit(fr30.training_set(rows, cuts), iterations=4, depth=3), fr30.current_state(rows, cuts))
    runs, whole = [], fr30._windowed

    def windowed(*given):
        runs.append(given)
        return whole(*given)

    monkeypatch.setattr(fr30, "_windowed", windowed)
    risk = fr30.risk(rows, cuts, iterations=4, depth=3)
    assert len(runs) == 1
    assert values(risk, "codigo", "risk_30d", "banda") == values(expected, "codigo", "risk_30d", "banda")
    # what follows reads the written windows
    assert "Window" not in risk._jdf.queryExecution().optimizedPlan().toString()


def test_too_few_rows_use_the_rules(spark):
    rows = features.visit_timeline(visits(spark, machine("A-1", [0, 5, 10])), AS_OF)
    assert values(fr30.risk(rows), "codigo", "risk_30d") == {"A-1": 0.9}
    assert values(anomaly.detect(rows), "codigo", "banda").keys() == {"A-1"}


def test_machines_without_features_get_no_band(spark):
    rows = features.visit_timeline(visits(spark, machine("A-1", range(0, 60, 4)) + machine("B-1", [0], 50)), AS_OF)
    got = values(anomaly.detect(rows, trees=10), "codigo", "anomaly_score", "banda")
    assert got["B-1"] == (0.0, NO_DATA) and got["A-1"][1] != NO_DATA


def test_life_table(spark, log):
    rows, _ = log
    table = rul.life_table(rows, "2001-08-02 00:00:00")
    assert table.count() == rows.select("codigo").distinct().count()
    assert table.filter("rul50_d < 0 or modelo_usado is null").count() == 0


def test_telemetry_regression(spark):
    from fleetkpi.queries.reports import telemetry

    readings = telemetry(spark, SF_DIR)
    scored = tm.score(tm.fit(readings, trees=5, depth=6), readings)
    stats = scored.agg(
        F.corr("fr30_risk", "prob_falla_30d").alias("p"), F.corr("rul_days", "rul_estimado").alias("r"),
        F.min("fr30_risk").alias("lo"), F.max("fr30_risk").alias("hi"),
    ).first()
    assert stats.p > 0.9 and stats.r > 0.9 and 0 <= stats.lo <= stats.hi <= 1


def test_missing_indicators_default(spark):
    f = spark.createDataFrame([("A", 0.6, "x")], "codigo string, risk_30d double, banda string")
    u = spark.createDataFrame([("B", 5.0, 6.0)], "codigo string, rul50_d double, rul90_d double")
    p = spark.createDataFrame([("C", 1.0, 2.0, 3.0)], "codigo string, forecast_7d_h double, forecast_30d_h double, horas_por_dia double")
    a = spark.createDataFrame([("A", 0.9, "y")], "codigo string, anomaly_score double, banda string")
    rows = kpi.assemble(f, u, p, a)
    got = values(rows, "codigo", "fr30_risk", "fr30_banda", "rul50_d", "forecast_7d_h", "anomaly_score", "anomaly_banda")
    assert got == {"A": (0.6, "x", 0.0, 0.0, 0.9, "y"), "B": (0.0, "", 5.0, 0.0, 0.0, ""), "C": (0.0, "", 0.0, 1.0, 0.0, "")}
    known = kpi.combine(f, u, p, a)
    alerts = {(r.codigo, r.alerta) for r in kpi.alerts(known).collect()}
    assert alerts == {("A", "alto_riesgo_fr30"), ("A", "anomalia"), ("B", "rul_critico")}
    counts = kpi.band_counts(known).first()
    assert (counts.total_equipos, counts.fr30_alto, counts.fr30_bajo, counts.rul_critico, counts.anomalia_alta) == (2, 1, 0, 1, 1)
    total = kpi.executive_summary(known).first()
    assert (total.equipos_mantenimiento_urgente, total.promedio_rul50, total.promedio_fr30) == (1, 5.0, 0.6)
    assert [r.codigo for r in kpi.maintenance_alerts(known).collect()] == ["B"]


def test_trend_labels(spark):
    df = spark.createDataFrame(
        [("2024-01", 1.0), ("2024-02", 1.04), ("2024-03", 1.2), ("2024-04", 0.9)], "mes string, v double"
    )
    assert values(kpi.trend_label(df, "v"), "mes", "tendencia") == {
        "2024-01": None, "2024-02": "estable", "2024-03": "creciente", "2024-04": "decreciente",
    }


def test_product_limit_and_censored_weibull(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        life, seen = rng.weibullvariate(40, 1.7), rng.uniform(5, 90)
        rows.append((f"M-{i}", "C", max(1, round(min(life, seen))), int(life <= seen)))
    rows += [("X-1", "few", 3, 1), ("X-2", "few", 3, 0), *[(f"Y-{i}", "same", 7, 1) for i in range(9)]]
    days = survival.life_table(spark.createDataFrame(rows, "codigo string, clase string, duration long, event int"))
    got = {(r.clase, r.duration): r for r in survival.product_limit(days).collect()}
    left, share, var = sum(r[1] == "C" for r in rows), 1.0, 0.0
    for day in sorted({r[2] for r in rows if r[1] == "C"}):
        ended, opened = (sum(r[1] == "C" and r[2] == day and r[3] == e for r in rows) for e in (1, 0))
        found = got["C", day]
        assert (found.eventos, found.abiertos, found.en_riesgo) == (ended, opened, left)
        share, var = share * (1 - ended / left), var + (ended / (left * (left - ended)) if ended < left else 0)
        assert found.supervivencia == pytest.approx(share, abs=1e-12) and found.error == pytest.approx(share * math.sqrt(var))
        left -= ended + opened
    assert got["same", 7].supervivencia == 0.0 and got["few", 3].supervivencia == 0.5
    fitted = {r.clase: r for r in survival.fit_quality(days, survival.fit_censored(days)).collect()}
    assert set(fitted) == {"C"}
    c = fitted["C"]
    assert c["lambda"] == pytest.approx(40, rel=0.05) and c.k == pytest.approx(1.7, rel=0.06) and c.residuo < 1e-9
    assert 0.95 < c.fit_quality < 1 and c.confidence_interval == [c.rul90_d, c.rul10_d] and abs(c.mediana_km - c.rul50_d) < 3


def test_open_intervals_run_from_the_last_visit(spark):
    log = visits(spark, [(1, "A-1", "2024-12-01 00:00:00"), (2, "A-1", "2024-12-11 00:00:00"), (3, "B-1", "2010-01-01 00:00:00"), (4, "C-1", AS_OF)])
    rows = survival.censored_intervals(features.visit_timeline(log, AS_OF), AS_OF).collect()
    assert sorted((r.codigo, r.duration, r.event) for r in rows) == [("A-1", 10, 1), ("A-1", 20, 0), ("B-1", 1000, 0)]
    empty = survival.life_table(survival.censored_intervals(features.visit_timeline(log.limit(0), AS_OF), AS_OF))
    assert survival.fit_quality(empty, survival.fit_censored(empty)).count() == 0
