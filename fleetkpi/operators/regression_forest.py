"""Regression forests for several targets, grown level by level in one pass for all trees.

Features are cut into bins at quantiles once, and the bins are written, many rows packed into one. A level is one pass: a task adds up,
for each tree, node, feature and bin, the weights of its rows and their weighted targets; the sums of all
tasks meet in small groups of nodes, which hand on the best split of each node alone. Rows never move, and
what moves does not grow with them. Trees of all targets share the passes; a row's weight in a tree follows
from a hash of its key, so a tree does not depend on how the rows are dealt over tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise

# the functions travel with the job, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 64
#: Nodes whose sums meet in one group.
GROUP = 128
#: Rows that a task adds up together.
ROWS = 100_000
#: A split has to leave this weight on both sides.
LEAST = 1
#: Chances that a row is drawn 0, 1, 2, ... times at most when as many rows are drawn as there are.
_DRAWN = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
_SUMS = "tree int, node int, sums binary"
_SPLITS = "tree int, node int, feature int, cut int, weight double, total double, left_weight double, left_total double"
_NODES = "target int, tree int, node int, feature int, cut int, value double, weight double"


@dataclass
class RegressionForest:
    """Bin edges of the features, and nodes numbered from 1 so that those below i are 2i and 2i + 1; feature -1 is a leaf."""

    columns: list[str]
    targets: list[str]
    edges: list[list[float]]
    nodes: pd.DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c, [float(x) for x in e]) for i, (c, e) in enumerate(zip(self.columns, self.edges, strict=True))]
        spark.createDataFrame(rows, "position int, name string, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")
        spark.createDataFrame(list(enumerate(self.targets)), "position int, name string").write.mode("overwrite").parquet(f"{path}/targets")
        spark.createDataFrame(self.nodes, _NODES).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RegressionForest:
        edges = spark.read.parquet(f"{path}/edges").orderBy("position").collect()
        targets = spark.read.parquet(f"{path}/targets").orderBy("position").collect()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("target", "tree", "node").toPandas()
        return cls([r["name"] for r in edges], [r["name"] for r in targets], [list(r["edges"]) for r in edges], nodes)


def _binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of each value, [row, feature]: how many edges lie below it."""
    return np.stack([np.searchsorted(np.array(e), values[:, i]) for i, e in enumerate(edges)], axis=1)


class _Trees:
    """Splits of all trees as arrays [tree, node]; a node that is not split has feature -1."""

    def __init__(self, trees: int, depth: int):
        self.feature = np.full((trees, 2 << depth), -1, np.int64)
        self.cut = np.zeros((trees, 2 << depth), np.int64)

    def add(self, nodes: pd.DataFrame) -> None:
        at = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        self.feature[at], self.cut[at] = nodes["feature"].to_numpy(), nodes["cut"].to_numpy()

    def reached(self, tree: int, bins: np.ndarray, levels: int, stay: bool = False) -> np.ndarray:
        """Node of each row after so many levels; where its branch ended before, 0 or the last node (`stay`)."""
        own = np.arange(self.feature.shape[1])
        split = self.feature[tree] >= 0
        feature, cut = np.where(split, self.feature[tree], 0), np.where(split, self.cut[tree], BINS + 1)
        below = np.where(split, 2 * own, own if stay else 0)
        flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        at = np.ones(len(bins), np.int64)
        for _ in range(levels):
            right = flat.take(feature.take(at) + first) > cut.take(at)
            at = below.take(at) + right
        return at


def _weights(keys: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often each row is drawn for a tree."""
    if not bootstrap:
        return np.ones(len(keys))
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed * 1_000_003 + tree * 7919 + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_DRAWN, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right").astype(np.float64)


def _sums(trees: _Trees, level: int, targets: int, each: int, features: int, seed: int, bootstrap: bool):
    """Weights and weighted targets of a level by node, feature and bin."""
    first = 1 << level
    size = first * (BINS + 1)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((targets * each, 2, features, size))
        seen = False
        for batch in _gathered(batches):
            seen = True
            bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(-1, features)
            keys = np.frombuffer(b"".join(batch["keys"]), np.int64)
            values = np.concatenate([np.frombuffer(y).reshape(targets, -1) for y in batch["ys"]], axis=1)
            for number in range(each):
                weights = _weights(keys, number, seed, bootstrap)
                drawn = np.flatnonzero(weights)
                mine, w = bins.take(drawn, axis=0), weights.take(drawn)
                columns = [mine[:, feature].astype(np.int64) for feature in range(features)]
                for target, y in enumerate(values):
                    tree = target * each + number
                    node = trees.reached(tree, mine, level)
                    weighted = w * y.take(drawn)
                    # rows whose branch has ended are counted in a node before the first, which is cut off
                    place = np.maximum(node - (first - 1), 0) * (BINS + 1)
                    for feature in range(features):
                        cell = place + columns[feature]
                        total[tree, 0, feature] += np.bincount(cell, w, size + BINS + 1)[BINS + 1 :]
                        total[tree, 1, feature] += np.bincount(cell, weighted, size + BINS + 1)[BINS + 1 :]
        for tree in range(targets * each if seen else 0):
            # by node, then weights and targets, feature, bin
            parts = total[tree].reshape(2, features, first, BINS + 1).transpose(2, 0, 1, 3)
            some = np.flatnonzero(parts[:, 0, 0].any(axis=1))
            yield pd.DataFrame({"tree": tree, "node": first + some, "sums": [parts[at].tobytes() for at in some]})

    return rows


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    many = 0
    for batch in batches:
        for at in range(len(batch)):
            held.append(batch.iloc[at : at + 1])
            many += int(held[-1]["n"].iloc[0])
            if many >= ROWS:
                yield pd.concat(held)
                held, many = [], 0
    if many:
        yield pd.concat(held)


def _splits(features: int):
    def best(rows: pd.DataFrame) -> pd.DataFrame:
        """The best split of each node by the sums of all tasks; feature -1 where none is better than none."""
        rows = rows.sort_values(["tree", "node"], kind="stable")
        sums = np.frombuffer(b"".join(rows["sums"])).reshape(len(rows), -1)
        heads = rows[["tree", "node"]].drop_duplicates()
        starts = np.flatnonzero(~rows.duplicated(["tree", "node"]).to_numpy())
        sums = np.add.reduceat(sums, starts, axis=0).reshape(len(heads), 2, features, BINS + 1)
        whole = sums[:, :, 0].sum(axis=2)
        weight, total = whole[:, 0], whole[:, 1]
        left = np.cumsum(sums, axis=3)[..., :-1].reshape(len(heads), 2, -1)
        right = whole[:, :, None] - left
        usual = total**2 / np.maximum(weight, LEAST)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, 1] ** 2 / left[:, 0] + right[:, 1] ** 2 / right[:, 0] - usual[:, None]
        gain = np.where((left[:, 0] >= LEAST) & (right[:, 0] >= LEAST), gain, -np.inf)
        at = gain.argmax(axis=1)
        node = np.arange(len(heads))
        # a gain that is rounding noise splits nothing
        splits = gain[node, at] > 1e-12 * usual
        return heads.assign(
            feature=np.where(splits, at // BINS, -1), cut=np.where(splits, at % BINS, 0),
            weight=weight, total=total, left_weight=left[node, 0, at], left_total=left[node, 1, at],
        )

    return best


def fit_regression_forest(
    df: DataFrame,
    columns: Sequence[str],
    targets: Sequence[str],
    row_key: Sequence[str],
    trees: int = 20,
    depth: int = 10,
    seed: int = 42,
    bootstrap: bool = True,
) -> RegressionForest:
    """Grow `trees` trees for each target on bootstrap samples, nulls of features as 0.

    ``row_key`` tells rows apart; rows without a target are left out. Every split is the best of all
    features and bins by the reduction of variance.
    """
    columns, targets = list(columns), list(targets)
    known = F.lit(True)
    for target in targets:
        known = known & F.col(target).isNotNull()
    filled = df.filter(known).select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
        *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)],
        F.xxhash64(F.lit(seed), *row_key).alias("key"),
    )
    cuts = filled.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)] + [1.0], 10_000).alias(c) for c in columns]).first()
    if cuts[columns[0]] is None:
        raise ValueError("no rows to fit on")
    # the largest value bounds no bin
    edges = [sorted(set(cuts[c]))[:-1] for c in columns]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            bins = _binned(batch[columns].to_numpy(np.float64), edges).astype(np.uint8)
            ys = np.stack([batch[f"y{i}"].to_numpy(np.float64) for i in range(len(targets))])
            yield pd.DataFrame({"n": [len(batch)], "keys": [batch["key"].to_numpy(np.int64).tobytes()], "ys": [ys.tobytes()], "bins": [bins.tobytes()]})

    # a row stands for a batch of rows: each pass takes it apart at once
    table = materialise(filled.mapInPandas(binned, "n int, keys binary, ys binary, bins binary"))
    grown, found = _Trees(len(targets) * trees, max(depth, 1)), []
    for level in range(max(depth, 1)):
        sums = table.mapInPandas(_sums(grown, level, len(targets), trees, len(columns), seed, bootstrap), _SUMS)
        splits = sums.groupBy("tree", F.floor(F.col("node") / GROUP).alias("part")).applyInPandas(_splits(len(columns)), _SPLITS)
        # bounded: a row for each tree and node of a level, whatever the table holds
        nodes = splits.toPandas().query("weight > 0").sort_values(["tree", "node"], ignore_index=True)
        if not depth:
            nodes["feature"] = -1
        nodes["target"], nodes["value"] = nodes["tree"] // trees, nodes["total"] / nodes["weight"]
        split = nodes[nodes["feature"] >= 0]
        found.append(nodes)
        if level + 1 == depth:
            # the deepest nodes are what the last splits leave on their sides
            for side in (0, 1):
                w = split["left_weight"] if not side else split["weight"] - split["left_weight"]
                y = split["left_total"] if not side else split["total"] - split["left_total"]
                found.append(split.assign(node=2 * split["node"] + side, feature=-1, cut=0, weight=w, value=y / w))
        if split.empty:
            break
        grown.add(nodes)
    wanted = [c.split()[0] for c in _NODES.split(", ")]
    nodes = pd.concat(found, ignore_index=True)[wanted].sort_values(["tree", "node"], ignore_index=True)
    return RegressionForest(columns, targets, edges, nodes)


def predict(df: DataFrame, forest: RegressionForest, names: Sequence[str]) -> DataFrame:
    """Add the mean of the trees' leaves for each target, under the given names."""
    depth = int(forest.nodes["node"].max()).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast((forest.nodes, forest.edges))
    features = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in forest.columns])
    kind = ", ".join(f"p{i} double" for i in range(len(names)))

    @F.pandas_udf(kind)
    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, edges = shared.value
        many = int(nodes["tree"].max()) + 1
        grown = _Trees(many, depth)
        grown.add(nodes)
        value = np.zeros(grown.feature.shape)
        value[nodes["tree"].to_numpy(), nodes["node"].to_numpy()] = nodes["value"].to_numpy()
        target = nodes.groupby("tree")["target"].first().to_numpy()
        for batch in batches:
            bins = _binned(batch.to_numpy(np.float64), edges)
            out = np.zeros((len(names), len(batch)))
            for tree in range(many):
                at = grown.reached(tree, bins, depth, stay=True)
                out[target[tree]] += value[tree, at]
            yield pd.DataFrame({f"p{i}": out[i] / (target == i).sum() for i in range(len(names))})

    scored = df.withColumn("_p", scores(features))
    return scored.select("*", *[F.col(f"_p.p{i}").alias(n) for i, n in enumerate(names)]).drop("_p")
