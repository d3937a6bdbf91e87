"""Isolation forest: trees grown in parallel on small hashed samples, scored row by row.

The work per tree is bounded by its sample (about 256 rows), so growing is a grouped-map over
100 small groups and scoring a vectorised function over the whole table. Only the grown trees
travel: at most 100 trees of at most 511 nodes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the tree functions travel with the job, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EULER = 0.5772156649015329
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, "
    "size int, depth int, sample int"
)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a random tree isolates one of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    deep = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes as (node, feature, threshold, left, right, size, depth); feature -1 is a leaf."""
    nodes: list[tuple] = []
    pending = [(0, np.arange(len(values)), 0)]
    next_id = 1
    while pending:
        node, rows, depth = pending.pop()
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append((node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        feature = int(rng.choice(open_features))
        # below the highest value, so that neither side is empty
        top = np.nextafter(high[feature], low[feature])
        threshold = float(min(rng.uniform(low[feature], high[feature]), top))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, next_id, next_id + 1, len(rows), depth))
        pending.append((next_id, rows[goes_left], depth + 1))
        pending.append((next_id + 1, rows[~goes_left], depth + 1))
        next_id += 2
    return nodes


@dataclass
class IsolationForest:
    """Feature scaling and the trees, as plain arrays."""

    columns: list[str]
    mean: list[float]
    scale: list[float]
    nodes: pd.DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        scaling = spark.createDataFrame(
            list(zip(range(len(self.columns)), self.columns, self.mean, self.scale)),
            "position int, name string, mean double, scale double",
        )
        scaling.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaling")
        nodes = spark.createDataFrame(self.nodes, NODE_SCHEMA)
        nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        scaling = spark.read.parquet(f"{path}/scaling").orderBy("position").collect()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return cls(
            [r["name"] for r in scaling],
            [r["mean"] for r in scaling],
            [r["scale"] for r in scaling],
            nodes,
        )


def fit_forest(
    df: DataFrame,
    columns: Sequence[str],
    row_key: Sequence[str] | None = None,
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
) -> IsolationForest:
    """Grow the forest on standardised columns, nulls as 0.

    With a unique ``row_key`` a row's trees follow from a hash of it, so the sample does not
    depend on how the data is partitioned. Without one every row draws a number, so that copies of
    a row are sampled apart and no tree gets more than its share. Every row stands for every tree,
    whatever the size of the table.
    """
    columns = list(columns)
    drawn = F.rand(seed) if row_key is None else F.xxhash64(F.lit(seed), *row_key)
    filled = df.select(
        drawn.alias("_draw"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
    )
    stats = filled.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    n = stats["n"]
    if not n:
        raise ValueError("no rows to fit on")
    mean = [stats[f"m_{c}"] for c in columns]
    # a deviation that is rounding noise counts as none
    scale = [
        stats[f"s_{c}"] if stats[f"s_{c}"] > 1e-12 * max(1.0, abs(m)) else 1.0
        for c, m in zip(columns, mean)
    ]

    scaled = [((F.col(c) - m) / s).alias(c) for c, m, s in zip(columns, mean, scale)]
    # pairs of a row and a tree are made and dropped within one compiled loop
    pairs = filled.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    chosen = pairs.filter(F.pmod(F.xxhash64(F.col("tree") + 1, F.col("_draw")), F.lit(n)) < sample)
    sampled = chosen.select("tree", "_draw", *scaled)
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("_draw", kind="stable")[columns].to_numpy(dtype=float)
        nodes = _grow(ordered, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(
            nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"]
        )
        return out.assign(tree=tree, sample=len(pdf))[
            ["tree", "node", "feature", "threshold", "left", "right", "size", "depth", "sample"]
        ]

    grown = sampled.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    # bounded: trees × (2 · 2^limit − 1) nodes, whatever the table holds
    nodes = grown.toPandas().sort_values(["tree", "node"], ignore_index=True)
    return IsolationForest(columns, mean, scale, nodes)


def _scorer(nodes: pd.DataFrame):
    """A function from a feature matrix to anomaly scores in (0, 1), higher is more anomalous."""
    trees = []
    for _, part in nodes.groupby("tree", sort=True):
        part = part.sort_values("node")
        leaf = part["depth"].to_numpy() + expected_path(part["size"].to_numpy())
        inner = part["feature"].to_numpy() >= 0
        own = np.arange(len(part))
        trees.append(
            (
                np.where(inner, part["feature"], 0),
                # a leaf leads to itself
                np.where(inner, part["threshold"], np.inf),
                np.stack([np.where(inner, part["right"], own), np.where(inner, part["left"], own)], axis=1).ravel(),
                int(part["depth"].max()),
                leaf,
                float(expected_path(part["sample"].iloc[0])) or 1.0,
            )
        )

    def score(values: np.ndarray) -> np.ndarray:
        # what cannot be compared goes right, as the largest value does
        flat = np.where(np.isnan(values), np.inf, values).ravel()
        first = np.arange(len(values)) * values.shape[1]
        depth = np.zeros(len(values))
        norm = 0.0
        for feature, threshold, below, levels, leaf, usual in trees:
            at = np.zeros(len(values), dtype=np.int64)
            for _ in range(levels):
                goes_left = flat.take(feature.take(at) + first) <= threshold.take(at)
                at = below.take(2 * at + goes_left)
            depth += leaf.take(at)
            norm += usual
        return np.power(2.0, -depth / norm)

    return score


def score_forest(df: DataFrame, forest: IsolationForest, name: str = "score") -> DataFrame:
    """Add the anomaly score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(forest.nodes)
    features = F.struct(
        *[
            ((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s).alias(c)
            for c, m, s in zip(forest.columns, forest.mean, forest.scale)
        ]
    )

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        score = _scorer(shared.value)
        for batch in batches:
            yield pd.Series(score(batch.to_numpy(dtype=float)))

    return df.withColumn(name, scores(features))


def decision(df: DataFrame, score: str = "score", contamination: float = 0.1) -> DataFrame:
    """``decision``: distance to the score of the most anomalous share; negative is anomalous."""
    limit = df.agg(
        F.percentile_approx(F.col(score), 1.0 - contamination, 100_000).alias("_limit")
    )
    return (
        df.crossJoin(F.broadcast(limit))  # one row
        .withColumn("decision", F.col("_limit") - F.col(score))
        .drop("_limit")
    )
