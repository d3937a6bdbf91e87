"""What the forests hand from pass to pass, and that faster walks end in the same leaves."""

from __future__ import annotations

import numpy as np
import pandas as pd

from fleetkpi.operators import forest, regression_forest
from fleetkpi.queries import catalogue


def _fail(*_):
    raise AssertionError("called for every row and tree")


def test_rows_are_drawn_without_a_lambda(spark, monkeypatch):
    monkeypatch.setattr(forest.F, "filter", _fail)
    rows = spark.range(2000).selectExpr("id", "cast(id % 17 as double) as a", "cast(id % 5 as double) as b")
    grown = forest.fit_forest(rows, ["a", "b"], ["id"], trees=10, sample=64)
    sizes = grown.nodes.groupby("tree")["sample"].first()
    assert len(sizes) == 10 and 30 < sizes.min() and sizes.max() < 120


def test_scores_equal_a_walk_row_by_row():
    rng = np.random.default_rng(3)
    names = ["node", "feature", "threshold", "left", "right", "size", "depth"]
    values = rng.normal(size=(300, 3)).round(1)
    values[0, 0], values[1, 1], values[2, 2] = np.nan, np.inf, -np.inf
    parts = [pd.DataFrame(forest._grow(rng.normal(size=(64, 3)).round(1), rng, 6), columns=names).assign(tree=t, sample=64) for t in range(9)]
    got = forest._scorer(pd.concat(parts))(values)
    for row, score in zip(values, got, strict=True):
        depth = 0.0
        for part in parts:
            nodes, at = part.set_index("node"), 0
            while nodes.at[at, "feature"] >= 0:
                at = nodes.at[at, "left" if row[nodes.at[at, "feature"]] <= nodes.at[at, "threshold"] else "right"]
            depth += nodes.at[at, "depth"] + float(forest.expected_path(nodes.at[at, "size"]))
        assert abs(score - 2.0 ** (-depth / (9 * float(forest.expected_path(64))))) < 1e-12


def test_binned_rows_travel_packed(spark, monkeypatch):
    tables = []
    write = regression_forest.materialise
    monkeypatch.setattr(regression_forest, "materialise", lambda df: tables.append(write(df)) or tables[-1])
    rows = spark.range(3000).selectExpr("id", "cast(id % 17 as double) as a", "cast(id % 17 as double) as y")
    grown = regression_forest.fit_regression_forest(rows, ["a"], ["y"], ["id"], trees=2, depth=6, bootstrap=False)
    assert tables[0].count() < 100 and tables[0].selectExpr("sum(n) as n").first().n == 3000
    off = regression_forest.predict(rows, grown, ["p"]).selectExpr("max(abs(p - y)) as off").first().off
    assert off < 1e-9


def test_saved_forest_scores_once(spark):
    scored = catalogue()["saved_forest_scores"].run(spark, "/root/testdata/sf0.001")
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
