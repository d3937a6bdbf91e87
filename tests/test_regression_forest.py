"""Regression forests against a search of all splits, and their independence of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from fleetkpi.operators import regression_forest as rf


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 20, 1500), rng.integers(0, 7, 1500), rng.normal(size=1500)], axis=1)
    y = x[:, 0] * 2 + (x[:, 1] > 3) * 30 + rng.normal(size=1500)
    rows = pd.DataFrame({"id": np.arange(1500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "z": -(x[:, 1] ** 2)})
    return spark.createDataFrame(rows), rows


def split(rows, y):
    """Best (feature, largest value on the left) of all, by the sum of squares that is left."""
    best = None
    for name in "ab":
        for cut in sorted(rows[name].unique())[:-1]:
            left = rows[name] <= cut
            loss = sum(((part - part.mean()) ** 2).sum() for part in (rows[y][left], rows[y][~left]))
            best = min(best or (loss, name, cut), (loss, name, cut))
    return best[1:]


def test_every_split_is_the_best_one(table):
    df, rows = table
    forest = rf.fit_regression_forest(df.repartition(5), ["a", "b"], ["y", "z"], ["id"], trees=1, depth=3, bootstrap=False)
    for number, y in enumerate("yz"):
        nodes = forest.nodes[forest.nodes.target == number].set_index("node")
        parts = {1: rows}
        for node in sorted(nodes.index):
            part = parts[node]
            assert nodes.at[node, "weight"] == len(part) and nodes.at[node, "value"] == pytest.approx(part[y].mean())
            feature = nodes.at[node, "feature"]
            if feature < 0:
                assert node >= 8 or part[y].nunique() == 1
                continue
            name, cut = forest.columns[feature], forest.edges[feature][nodes.at[node, "cut"]]
            assert (name, cut) == split(part, y)
            parts[2 * node], parts[2 * node + 1] = part[part[name] <= cut], part[part[name] > cut]


def test_partitions_make_no_difference(table):
    df, rows = table
    one, two = (rf.fit_regression_forest(df.repartition(n, "c"), ["a", "b", "c"], ["y", "z"], ["id"], trees=3, depth=5) for n in (1, 7))
    names = ["target", "tree", "node", "feature", "cut", "weight"]
    assert one.nodes[names].equals(two.nodes[names]) and np.allclose(one.nodes.value, two.nodes.value)
    weights = one.nodes[one.nodes.node == 1].weight
    assert len(set(weights)) > 1 and (abs(weights - len(rows)) < 200).all()
    again = rf.predict(rf.predict(df, one, ["p", "q"]), two, ["p2", "q2"]).toPandas()
    assert np.allclose(again.p, again.p2) and np.corrcoef(again.p, again.y)[0, 1] > 0.98 and np.corrcoef(again.q, again.z)[0, 1] > 0.98


def test_saved_forests_and_odd_rows(spark, table, tmp_path):
    df, _ = table
    forest = rf.fit_regression_forest(df, ["a", "b"], ["y"], ["id"], trees=2, depth=2)
    forest.save(spark, str(tmp_path))
    loaded = rf.RegressionForest.load(spark, str(tmp_path))
    assert loaded.edges == forest.edges and loaded.nodes.equals(forest.nodes.astype(loaded.nodes.dtypes))
    odd = spark.createDataFrame([(1, None, 1.0, 2.0), (2, 1.0, None, 4.0), (3, 5.0, 5.0, None)], "id int, a double, b double, y double")
    flat = rf.fit_regression_forest(odd, ["a", "b"], ["y"], ["id"], trees=1, depth=4, bootstrap=False)
    assert [r.p for r in rf.predict(odd, flat, ["p"]).orderBy("id").collect()][:2] == [2.0, 4.0]
    single = rf.fit_regression_forest(odd, ["a"], ["y"], ["id"], trees=1, depth=0, bootstrap=False)
    assert {r.p for r in rf.predict(odd, single, ["p"]).collect()} == {3.0}
    with pytest.raises(ValueError, match="no rows"):
        rf.fit_regression_forest(odd.limit(0), ["a"], ["y"], ["id"])
