"""Window edges, ties, and the same results for cut and uncut machines."""

from __future__ import annotations

import random
import statistics
import time

import pytest
from visitlog import AS_OF, values, visits

from fleetkpi.operators import features, profile
from fleetkpi.operators.timeline import NO_CUTS, ROWS_PER_SLICE, find_cuts, written
from fleetkpi.plans import anomaly, fr30


def test_thirty_days_apart(spark):
    log = visits(spark, [(1, "A-1", "2024-01-01 10:00:00"), (2, "A-1", "2024-01-31 10:00:00")])
    open_end = features.trailing_counts(log, {"n": 30})
    closed = features.trailing_counts(log, {"n": 30}, closed=True)
    assert values(open_end, "visit_id", "n") == {1: 1, 2: 1}
    assert values(closed, "visit_id", "n") == {1: 1, 2: 2}
    assert values(features.visits_around(log, 30, 30), "visit_id", "visitas_cercanas") == {1: 2, 2: 2}


def test_ties_share_their_counts(spark):
    at = "2024-01-01 10:00:00"
    log = visits(spark, [(1, "A-1", at), (2, "A-1", at), (3, "A-1", at, None, "FRENOS")])
    assert set(values(features.trailing_counts(log, {"n": 30}), "visit_id", "n").values()) == {3}
    systems = features.system_counts(log)
    assert values(systems, "visit_id", "sistema_count_60d", "sistemas_unicos_60d") == {
        1: (2, 2),
        2: (2, 2),
        3: (1, 2),
    }
    gaps = values(features.visit_timeline(log, AS_OF), "visit_id", "tbf_dias")
    assert gaps == {1: None, 2: 0.0, 3: 0.0}


def test_distinct_systems_leave_after_sixty_days(spark):
    log = visits(
        spark,
        [
            (1, "A-1", "2024-01-01 00:00:00", None, "MOTOR"),
            (2, "A-1", "2024-02-29 23:59:59", None, "FRENOS"),  # one second short of 60 days
            (3, "A-1", "2024-04-29 00:00:00", None, "MOTOR"),
            (4, "A-1", "2024-04-29 23:59:59", None, "FRENOS"),  # exactly 60 days after visit 2
        ],
    )
    rows = features.system_counts(log)
    assert values(rows, "visit_id", "sistemas_unicos_60d") == {1: 1, 2: 2, 3: 2, 4: 2}
    assert values(rows, "visit_id", "sistema_count_60d") == {1: 1, 2: 1, 3: 1, 4: 1}


def test_partial_days_round_down(spark):
    log = visits(
        spark,
        [(1, "A-1", "2024-01-01 12:00:00", "2024-01-05 00:00:00"), (2, "A-1", "2024-01-03 11:59:59")],
    )
    rows = features.visit_timeline(log, AS_OF)
    assert values(rows, "visit_id", "tbf_dias")[2] == 1.0
    # the next entry lies before the exit: negative days, still "within 30 days"
    assert values(features.label_next_visit(rows), "visit_id", "days_to_next", "y") == {1: (-2.0, 1)}


def test_site_counts_need_three_visits(spark):
    two = [(1, "A-1", "2024-01-01 00:00:00"), (2, "A-1", "2024-01-02 00:00:00")]
    three = [(10 + i, "B-1", f"2024-01-0{i} 00:00:00") for i in (1, 2, 3)]
    rows = features.site_counts(features.visit_timeline(visits(spark, two + three), AS_OF))
    assert values(rows, "visit_id", "ingresos_30d") == {1: 1, 2: 1, 11: 1, 12: 2, 13: 3}


def test_fifth_visit_on(spark):
    rows = [(i, "A-1", f"2024-01-{i:02d} 00:00:00") for i in range(1, 6)]
    rows += [(i + 10, "B-1", f"2024-01-{i:02d} 00:00:00") for i in range(1, 5)]
    timeline = features.visit_timeline(visits(spark, rows), AS_OF)
    assert [r.visit_id for r in timeline.filter("n_min5").collect()] == [5]


def test_recorded_counters_win(spark):
    df = spark.createDataFrame([(3.0, 50.0, None)], "dias_desde_averia double, horas_desde_averia double, tbf_dias double")
    row = features.recorded_tbf(df).first()
    assert (row.tbf_dias, row.tbf_horas) == (3.0, 50.0)


def test_empty_log(spark):
    empty = visits(spark, [(1, "A-1", "2024-01-01 00:00:00")]).limit(0)
    assert not find_cuts(empty)
    timeline = features.visit_timeline(empty, AS_OF)
    assert fr30.training_set(timeline).count() == 0
    assert anomaly.feature_table(timeline).count() == 0
    assert profile.completeness(empty, ["codigo"]).first().completitud_pct is None
    report = profile.quality_report(timeline, AS_OF, ["codigo"])
    assert values(report, "tipo", "valor")["puntaje"] == 100.0
    assert profile.enough_history(empty).first().registros == 0


@pytest.fixture(scope="module")
def crowded(spark):
    """One machine with a third of all visits, bursts, ties and long silences."""
    rng = random.Random(7)
    rows, visit_id = [], 0
    for machine in range(12):
        size = 240 if machine == 0 else rng.choice([1, 2, 4, 5, 20, 60, 90])
        at = 1_600_000_000
        for _ in range(size):
            at += rng.choice([0, 0, 3600, 7200, 86400, 86400 * 3, 86400 * 30, 86400 * 60, 86400 * 45 + 7])
            visit_id += 1
            leave = None if rng.random() < 0.2 else at + rng.randint(0, 90) * 3600
            rows.append((visit_id, f"M-{machine:03d}", at, leave, rng.choice(["A", "B", "C", "D"])))
    df = spark.createDataFrame(rows, "visit_id long, codigo string, i long, o long, sistema_afectado string")
    return df.selectExpr(
        "visit_id", "codigo", "timestamp_seconds(i) as fecha_in", "timestamp_seconds(o) as fecha_out",
        "sistema_afectado", "'CORRECTIVA' as tipo_atencion", "cast(null as double) as mttr_horas",
        "'F' as flota", "'C' as clase",
    ).persist()


@pytest.mark.parametrize(
    "job",
    [
        lambda log, cuts: features.visit_timeline(log, AS_OF, cuts),
        lambda log, cuts: features.trailing_counts(log, cuts=cuts),
        lambda log, cuts: features.trailing_counts(log, closed=True, cuts=cuts),
        lambda log, cuts: features.system_counts(log, cuts=cuts),
        lambda log, cuts: features.period_labels(log, cuts=cuts),
        lambda log, cuts: features.visits_around(log, 30, 30, cuts),
        lambda log, cuts: fr30.training_set(features.visit_timeline(log, AS_OF, cuts), cuts),
        lambda log, cuts: anomaly.feature_table(features.visit_timeline(log, AS_OF, cuts), cuts),
    ],
    ids=["timeline", "counts", "closed", "systems", "labels", "around", "training", "features"],
)
def test_cut_machines_give_the_same(crowded, job):
    cuts = find_cuts(crowded, 25)
    assert cuts.machines.count() > 1
    plain, cut = job(crowded, NO_CUTS), job(crowded, cuts)
    names = sorted(plain.columns)
    assert sorted(cut.columns) == names

    def rows(df):
        return sorted((tuple(str(r[n]) for n in names) for r in df.collect()))

    assert rows(plain) == rows(cut)


def test_counts_equal_a_range_join(crowded):
    a, b = crowded.alias("a"), crowded.alias("b")
    joined = a.join(b, "codigo").where(
        "b.fecha_in > a.fecha_in - interval 30 days and b.fecha_in <= a.fecha_in"
    )
    expected = values(joined.groupBy("a.visit_id").count(), "visit_id", "count")
    counted = features.trailing_counts(crowded, {"n": 30}, cuts=find_cuts(crowded, 25))
    assert values(counted, "visit_id", "n") == expected


def test_cuts_split_the_crowded_machine(crowded):
    cuts = find_cuts(crowded, 25)
    starts = {r.codigo: r._starts for r in cuts.machines.collect()}["M-000"]
    # ties and visits of one hour stay together, so a slice may be longer than 25 rows
    assert 7 <= len(starts) <= 10 and starts == sorted(set(starts))
    assert not find_cuts(crowded, ROWS_PER_SLICE)


def test_a_burst_is_cut_evenly(spark):
    """One early visit, then 4,000 within 20 days."""
    at = "timestamp_seconds(1600000000 + if(id = 0, 0, 300000000 + id * 432))"
    log = spark.range(4001).selectExpr("id as visit_id", "'M-1' as codigo", f"{at} as fecha_in")
    cuts = find_cuts(log, 250)
    starts = cuts.machines.first()._starts
    sizes = spark.range(1, 4001).selectExpr("(1600000000 + 300000000 + id * 432) * 1000000 as at").collect()
    counts = [sum(a <= r.at < b for r in sizes) for a, b in zip(starts, [*starts[1:], 1 << 62])]
    assert len(starts) >= 15 and max(counts) <= 270
    rows = features.trailing_counts(log, {"n": 30}, cuts=cuts)
    assert values(rows.filter("visit_id in (1, 2000, 4000)"), "visit_id", "n") == {1: 1, 2000: 2000, 4000: 4000}


def test_windows_of_a_larger_log_take_more_tasks(crowded):
    """Tasks follow the number of visits, whatever the shuffle partitions; the rows are the same."""
    cuts = find_cuts(crowded, rows_per_task=10)
    assert not cuts and cuts.tasks >= crowded.count() / 10 and find_cuts(crowded).tasks is None
    for job in (
        lambda c: features.visit_timeline(crowded, AS_OF, c),
        lambda c: fr30.training_set(features.visit_timeline(crowded, AS_OF, c), c),
        lambda c: fr30.current_state(written(features.visit_timeline(crowded, AS_OF, c), c), c),
    ):
        dealt = job(cuts)
        assert dealt.rdd.getNumPartitions() == cuts.tasks
        assert sorted(map(str, dealt.collect())) == sorted(map(str, job(NO_CUTS).collect()))


def test_windows_share_one_shuffle(spark):
    """The feature table needs a single exchange by machine."""
    log = visits(spark, [(i, "A-1", f"2024-01-{i:02d} 00:00:00") for i in range(1, 9)])
    table = anomaly.feature_table(features.visit_timeline(log, AS_OF))
    plan = table._jdf.queryExecution().sparkPlan().toString()
    executed = table._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    assert executed.count("Exchange hashpartitioning") == 1


def test_window_statistics_equal_brute_force(spark, crowded):
    timeline = features.visit_timeline(crowded, AS_OF)
    names = ["codigo", "visit_id", "fecha_in", "tbf_dias", "ciclo_horas", "sistema_afectado"]
    log = sorted(timeline.select(*names).collect(), key=lambda r: (r.codigo, r.fecha_in, r.visit_id))
    found = {r.visit_id: r for r in features.anomaly_windows(timeline).collect()}
    assert len(found) == len(log)

    def deviation(some):
        return statistics.stdev(some) if len(some) > 1 else None if some else 0.0

    for row in log:
        ages = [(row.fecha_in - o.fecha_in).total_seconds() / 86400 if o.codigo == row.codigo else -1 for o in log]
        near = [o for o, age in zip(log, ages) if 0 <= age <= 30]
        far = [o for o, age in zip(log, ages) if 0 <= age <= 60]
        t30, t60 = ([o.tbf_dias for o in x if o.tbf_dias is not None] for x in (near, far))
        h30, h60 = ([o.ciclo_horas for o in x if o.ciclo_horas is not None] for x in (near, far))
        s30 = [o.sistema_afectado for o in near]
        slope = statistics.linear_regression(range(len(t60)), t60).slope if len(t60) >= 3 else 0.0
        expected = {
            "ingresos_30d": len(near),
            "ingresos_60d": len(far),
            "tbf_med_30d": statistics.median(t30 or [0]),
            "tbf_std_30d": deviation(t30),
            "tbf_min_30d": min(t30, default=0),
            "tbf_max_30d": max(t30, default=0),
            "tbf_med_60d_rango": statistics.median(t60 or [0]),
            "tbf_trend": slope,
            "sistemas_unicos_30d": len(set(s30)),
            "sistema_dominante_30d": max(map(s30.count, s30)),
            "sistemas_unicos_60d": len({o.sistema_afectado for o in far}),
            "mttr_med_30d": statistics.median(h30 or [24]),
            "mttr_std_30d": deviation(h30),
            "mttr_max_30d": max(h30, default=24),
            "mttr_med_90d_rango": statistics.median(h60 or [24]),
        }
        assert {c: found[row.visit_id][c] for c in expected} == pytest.approx(expected, abs=1e-9)


def test_dense_machines_take_linear_time(spark):
    """16,000 visits of one machine in 20 days."""
    log = spark.range(16000).selectExpr(
        "id as visit_id", "'M-1' as codigo", "timestamp_seconds(1600000000 + id * 108) as fecha_in",
        "108 / 86400D + id % 7 as tbf_dias", "cast(id % 97 as double) as ciclo_horas", "concat('S', id % 5) as sistema_afectado",
    ).persist()
    features.anomaly_windows(log.limit(100)).count()  # starts the workers
    began = time.monotonic()
    last = features.anomaly_windows(log).orderBy("visit_id").collect()[-1]
    assert time.monotonic() - began < 5
    assert (last.ingresos_30d, last.sistemas_unicos_30d, last.sistema_dominante_30d) == (16000, 5, 3200)


def test_window_statistics_of_odd_rows(spark):
    """No rows; neither code nor entry; values that are no numbers; ties over several batches."""
    kinds = "visit_id long, codigo string, fecha_in timestamp, tbf_dias double, ciclo_horas double, sistema_afectado string, nota string"
    empty = spark.createDataFrame([], kinds)
    assert features.anomaly_windows(empty).count() == 0
    rows = [(1, None, None, None, None, None, "x"), (2, "A", None, 1.0, float("nan"), "M", None)]
    got = values(features.anomaly_windows(spark.createDataFrame(rows, kinds)), "visit_id", "ingresos_30d", "tbf_med_30d", "mttr_med_30d", "nota")
    assert got == {1: (1, 0.0, 24.0, "x"), 2: (1, 1.0, 24.0, None)}
    ties = spark.range(50).selectExpr(
        "id as visit_id", "'A' as codigo", "timestamp_seconds(0) as fecha_in", "1D as tbf_dias", "2D as ciclo_horas", "'M' as sistema_afectado"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert set(values(features.anomaly_windows(ties), "visit_id", "ingresos_60d", "tbf_std_30d").values()) == {(50, 0.0)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
