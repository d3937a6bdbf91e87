"""Connected components of an edge list, by alternating stars on written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Each node of these edges with the smallest node that they connect it to, itself left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[label[far]], "b": nodes[far]})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > 1_000_000:
            held = [forest(*pd.concat(held)[["a", "b"]].to_numpy().T)]
    if held:
        yield forest(*pd.concat(held)[["a", "b"]].to_numpy().T)


def _flat(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task keeps a forest of what it has."""
    return edges.mapInPandas(_contract, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reached.

    Edges hold no nulls. Loops and repeated edges do no harm; a node with only a loop is left out.
    Each round first ties the larger neighbours of a node to its smallest one, then the smaller
    ones, until nothing changes. Joins and minima are shared out by node, a hub's edges are combined
    before they move, and every round is written, so a lost executor costs one round.
    """
    edges = edges.select("a", "b").where("a <> b")
    current = materialise(_flat(edges).distinct())
    for _ in range(ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = materialise(large)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b")
        small = materialise(small.select(F.col("m").alias("a"), "b").distinct())
        # stars: no node has two smaller neighbours, or smaller and larger ones
        ends = small.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(small.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        mixed = ends.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down + up > 1 and down > 0")
        if mixed.limit(1).count() == 0:
            stars = small
            return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        current = small
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
