from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import SF_DIR
from pyspark.sql import types as T

from fleetkpi.queries import catalogue
from fleetkpi.streaming.state import PROVIDER, keyed_alerts
from fleetkpi.streaming.visits import alert_stream, clean_stream, read_events, run_to_end, tumbling_stream

CATALOGUE = catalogue()
SCHEMA = T.StructType(
    [
        T.StructField("codigo", T.StringType()),
        T.StructField("fecha_in", T.TimestampType()),
        T.StructField("mttr_horas", T.DoubleType()),
    ]
)


def replay(spark, folder, batches):
    """One file per batch, in order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "codigo string, fecha_in string, mttr_horas double")
        df = df.withColumn("fecha_in", df.fecha_in.cast("timestamp"))
        df.coalesce(1).write.parquet(f"{folder}/{i}")
    return read_events(spark, f"{folder}/*", SCHEMA, files=1)


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    stream = replay(
        spark,
        tmp_path,
        [
            [("a-1", "2024-01-01 10:00:00", 1.0), (" A-1 ", "2024-01-01 10:00:00", 2.0), ("", "2024-01-01 10:00:00", 1.0)],
            [("A-1", "2024-01-01 10:00:00", 3.0), ("A-1", "2024-01-01 11:00:00", 3.0)],
        ],
    )
    rows = run_to_end(
        spark, clean_stream(stream, "2020-01-01", "2030-01-01").select("codigo", "fecha_in"), ["codigo", "fecha_in"], "append"
    )
    assert sorted((r.codigo, r.fecha_in.hour) for r in rows.collect()) == [("A-1", 10), ("A-1", 11)]


def test_counts_equal_the_batch_result(spark, tmp_path):
    batches = [
        [("A-1", "2024-01-01 10:00:00", 1.0), ("A-1", "2024-01-02 10:00:00", 2.0)],
        [("B-1", "2024-01-02 11:00:00", 4.0), ("A-1", "2024-01-03 10:00:00", 6.0)],
    ]
    stream = replay(spark, tmp_path, batches)
    daily = run_to_end(spark, tumbling_stream(stream), ["desde"])
    assert {(r.desde.day, r.ingresos, r.mttr_promedio) for r in daily.collect()} == {(1, 1, 1.0), (2, 2, 3.0), (3, 1, 6.0)}
    alerts = run_to_end(spark, alert_stream(stream), ["codigo", "desde"])
    assert {r.codigo for r in alerts.collect()} == {"A-1"}
    assert alerts.count() == 28 and alerts.agg({"ingresos": "max"}).first()[0] == 3


def test_visits_beyond_the_lateness_are_dropped(spark, tmp_path):
    batches = [
        [("A-1", "2024-03-01 10:00:00", 1.0)],
        [("A-1", "2024-03-10 10:00:00", 1.0)],
        [("A-1", "2024-03-10 11:00:00", 1.0)],  # the new limit holds from the next batch on
        [("A-1", "2024-03-01 12:00:00", 1.0), ("A-1", "2024-03-09 12:00:00", 1.0)],
    ]
    daily = run_to_end(spark, tumbling_stream(replay(spark, tmp_path, batches)), ["desde"], allow_late=True)
    assert {(r.desde.day, r.ingresos) for r in daily.collect()} == {(1, 1), (10, 2), (9, 1)}


def test_late_rows_are_reported(spark, tmp_path):
    batches = [[("A-1", f"2024-0{m}-01 10:00:00", 1.0)] for m in (3, 5, 7, 3)]
    with pytest.raises(ValueError, match="later than the watermark"):
        run_to_end(spark, tumbling_stream(replay(spark, tmp_path, batches)), ["desde"])


@pytest.mark.parametrize("name", ["stream_clean_visits", "stream_alerts", "stream_alerts_keyed", "stream_daily_counts"])
def test_one_file_and_twenty_overlapping_files_agree(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    run = CATALOGUE[name].run
    rows = [sorted(map(tuple, run(spark, folder).collect())) for folder in (SF_DIR, str(tmp_path))]
    assert rows[0] == rows[1] and rows[0]


def test_keyed_alerts_equal_the_windows_over_batches(spark, tmp_path):
    """Late visits within the watermark, ties, silences longer than a window; and one row of state a machine."""
    rng = random.Random(5)
    visits = []
    for machine in ("A-1", "B-1", "C-1"):
        at = datetime(2024, 1, 1)
        for _ in range(25):
            at += timedelta(hours=rng.choice([0, 1, 30, 80, 24 * 9, 24 * 45]))
            visits.append((machine, str(at), 1.0))
    visits.sort(key=lambda v: (v[1][:10], rng.random()))  # out of order within a day
    batches = [visits[i : i + 15] for i in range(0, len(visits), 15)]
    stream = replay(spark, tmp_path, batches)
    keyed, plain = (
        run_to_end(spark, made, ["codigo", "desde"], provider=provider)
        for made, provider in ((keyed_alerts(stream), PROVIDER), (alert_stream(stream), None))
    )
    rows = [sorted((r.codigo, r.desde, r.hasta, r.ingresos) for r in df.collect()) for df in (keyed, plain)]
    assert rows[0] == rows[1] and len(rows[0]) > 50


def test_a_machine_is_one_row_of_state(spark, tmp_path):
    visits = [[("A-1", f"2024-01-{d:02d} {h:02d}:00:00", 1.0) for h in range(6)] for d in (1, 2, 3)]
    stream = keyed_alerts(replay(spark, tmp_path / "in", visits))
    setting = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, PROVIDER)
    try:
        query = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, usual)
    # the list, and its timer by key and by time
    assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) <= 3
