"""Selected and running medians against sorting, and the indicators read off them."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from visitlog import AS_OF, values, visits

from fleetkpi.operators import features, machine_stats, reports, selection
from fleetkpi.operators.sliding import smallest
from fleetkpi.operators.timeline import NO_CUTS, find_cuts
from fleetkpi.plans import history, kpi


def test_medians_of_a_million_distinct_values_in_one_group(spark):
    rows = spark.range(1_000_001).selectExpr("'A' as codigo", "'v' as name", "cast(pmod(id * 7919, 1000001) as double) / 3 as value")
    few = spark.range(4).selectExpr("concat('B', id % 2) as codigo", "'v' as name", "cast(id as double) as value")
    got = selection.selected_medians(rows.unionByName(few), ["codigo"])
    assert values(got, "codigo", "median") == {"A": 500_000 / 3, "B0": 1.0, "B1": 2.0}


def test_only_the_bracket_comes_together(spark, monkeypatch):
    seen = []
    whole = selection._picked
    monkeypatch.setattr(selection, "_picked", lambda ranked, by: seen.append(ranked.count()) or whole(ranked, by))
    rows = spark.range(200_000).selectExpr("'v' as name", "cast(id as double) as value")
    assert selection.selected_medians(rows, []).first().median == 99_999.5
    assert seen[0] < 2_000


def test_one_large_group_is_not_brought_into_one_task(spark, monkeypatch):
    """Brackets and bin edges are handed to the values; a join by the group would gather them."""
    joins = []
    materialise, picked = selection.materialise, selection._picked

    def planned(df, *rest):
        joins.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df) if not rest else picked(df, *rest)

    monkeypatch.setattr(selection, "materialise", planned)
    monkeypatch.setattr(selection, "_picked", lambda ranked, by: planned(ranked, by))
    rows = spark.range(3_000).selectExpr("if(id < 0, 'w', 'v') as name", "int(id % 7) as paso", "cast(id as double) as value")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert selection.selected_medians(rows, []).first().median == 1499.5
        assert "BroadcastHashJoin" in joins[0] and "SortMergeJoin" not in joins[0]
        assert selection.running_medians(rows, [], "paso").count() == 7
        assert "BroadcastHashJoin" in joins[1] and "SortMergeJoin" not in joins[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_global_medians(spark):
    rng = random.Random(2)
    some = [(rng.choice([None, rng.random(), 0.5, -3.0]), rng.choice([1.0, 2.0]), None) for _ in range(501)]
    df = spark.createDataFrame(some, "a double, b double, c double")
    row = selection.global_medians(df, {x: F.col(x) for x in "abc"}).first()
    assert row.a == statistics.median(a for a, _, _ in some if a is not None)
    assert (row.b, row.c) == (statistics.median(b for _, b, _ in some), None)
    assert selection.global_medians(df.limit(0), {"a": F.col("a")}).first().a is None


@pytest.mark.parametrize("distinct", [7, 5000])
def test_running_medians(spark, distinct):
    rng = random.Random(distinct)
    rows = [(rng.choice("XXXY"), "v", rng.randint(0, 11) * 3, float(rng.randint(0, distinct))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "codigo string, name string, paso int, value double")
    got = {(r.codigo, r.paso): r.median for r in selection.running_medians(df, ["codigo"], "paso").collect()}
    assert got == {
        (k, s): statistics.median(v for c, _, at, v in rows if c == k and at <= s) for k, s in {(c, at) for c, _, at, _ in rows}
    }


def test_smallest_of_many_ranges():
    rng = np.random.default_rng(4)
    for size, top in ((1, 1), (2, 9), (500, 3), (2000, 10**6)):
        column = rng.integers(0, top, size) / 7
        begin = rng.integers(0, size, 300)
        end = begin + 1 + rng.integers(0, size, 300) % (size - begin)
        k = rng.integers(0, 1 << 30, 300) % (end - begin)
        assert smallest(column, begin, end, k).tolist() == [sorted(column[a:b])[i] for a, b, i in zip(begin, end, k)]
    assert smallest(np.zeros(0), *(np.zeros(0, np.int64) for _ in range(3))).size == 0


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    rows, number = [], 0
    for machine in range(7):
        at = 1_650_000_000 + machine * 2_000_000
        for _ in range(160 if machine == 0 else rng.choice([1, 2, 5, 9, 30])):
            at += rng.choice([0, 7200, 86400, 86400 * 4, 86400 * 35, 86400 * 6 + 77])
            number += 1
            rows.append((number, f"M-{machine}", at, at + rng.randint(0, 400) * 1234, rng.choice("ABCD")))
    df = spark.createDataFrame(rows, "visit_id long, codigo string, i long, o long, sistema_afectado string")
    return df.selectExpr(
        "visit_id", "codigo", "timestamp_seconds(i) as fecha_in", "timestamp_seconds(o) as fecha_out", "sistema_afectado",
        "'CORRECTIVA' as tipo_atencion", "cast(null as double) as mttr_horas", "'F' as flota", "'C' as clase",
    ).where(f"fecha_in <= timestamp '{AS_OF}'").persist()


def _rows(df):
    names = sorted(df.columns)
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


@pytest.mark.parametrize(
    "job",
    [
        lambda rows, cuts: machine_stats.machine_stats(rows, cuts),
        lambda rows, cuts: reports.machine_summary(rows, "ciclo_horas", cuts),
        lambda rows, cuts: kpi.basic_estimate(rows, "2023-06", "ciclo_horas", cuts),
        lambda rows, cuts: features.recent_versus_usual(rows, cuts=cuts),
        lambda rows, cuts: history.indicator_history(rows, AS_OF, cuts),
        lambda rows, cuts: history.risk_trends(rows, AS_OF, cuts),
    ],
    ids=["stats", "summary", "estimate", "recent", "history", "trends"],
)
def test_cut_machines_give_the_same(log, job):
    cuts = find_cuts(log, 25)
    assert cuts.machines.count() >= 1
    assert _rows(job(features.visit_timeline(log, AS_OF), NO_CUTS)) == _rows(job(features.visit_timeline(log, AS_OF, cuts), cuts))


def test_the_last_month_is_the_indicator_of_now(log):
    rows = features.visit_timeline(log, AS_OF)
    now = kpi.combine(*kpi.rule_indicators(rows, AS_OF))
    last = history.indicator_history(rows, AS_OF).where("mes = '2024-12'")
    names = ["codigo", *kpi.NUMBERS, "anomaly_score"]
    got, want = ({r.codigo: tuple(r)[1:] for r in df.select(*names).collect()} for df in (last, now))
    assert got.keys() == want.keys()
    for code, numbers in want.items():
        assert got[code] == pytest.approx(numbers, abs=1e-9)


def test_months_without_visits_carry_the_state_and_age(spark):
    rows = visits(spark, [(1, "A-1", "2024-01-10 00:00:00"), (2, "A-1", "2024-01-20 00:00:00"), (3, "A-1", "2024-04-01 00:00:00")])
    found = history.indicator_history(features.visit_timeline(rows, AS_OF), AS_OF)
    got = {r.mes: r for r in found.collect()}
    assert sorted(got) == [f"2024-{m:02d}" for m in range(1, 13)]
    assert [m for m, r in sorted(got.items()) if r.con_visita] == ["2024-01", "2024-04"]
    assert got["2024-01"].fr30_risk == pytest.approx(0.6) and got["2024-04"].fr30_risk == pytest.approx(0.2)
    assert got["2024-02"].rul50_d == pytest.approx(1.0) and got["2024-12"].rul50_d == 1.0
    months = {r.mes: r for r in history.month_summary(found).collect()}
    assert months["2024-01"].fr30_trend is None and months["2024-02"].fr30_trend == "estable" and months["2024-04"].fr30_trend == "decreciente"
    assert history.indicator_history(features.visit_timeline(rows.limit(0), AS_OF), AS_OF).count() == 0


def test_risk_trends(spark):
    rows = visits(spark, [(1, "A-1", "2024-12-01 00:00:00"), (2, "A-1", "2024-12-28 00:00:00"), (3, "B-1", "2024-12-30 00:00:00"), (4, "C-1", "2024-05-01 00:00:00")])
    got = {r.codigo: r for r in history.risk_trends(features.visit_timeline(rows, AS_OF), AS_OF).collect()}
    assert (got["A-1"].risk_30d, got["A-1"].trend_7d, got["A-1"].trend_30d) == (0.4, "creciente", "creciente")
    assert [(h.fecha, h.risk) for h in got["A-1"].historical_risks] == [("2024-12-17", 0.2), ("2024-12-24", 0.2), ("2024-12-31", 0.4)]
    assert (got["B-1"].trend_7d, got["C-1"].trend_7d, len(got["B-1"].historical_risks)) == (None, "estable", 1)
