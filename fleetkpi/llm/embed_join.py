"""Embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors with cosine >= t are at a squared distance of at most 2 - 2t. Vectors are turned by
a random rotation and cut into blocks of a few dimensions; each block gets the share of the squared
distance that it has of the dimensions. Of two near vectors at least one block is within its budget,
so the union of one range join for each block has all pairs. Exact cosines decide.

A block's range join shares its space out to the leaves of a k-d tree, fitted on a bounded sample
(its shape decides speed, not results). A vector has a home leaf and also visits the leaves before
it which its ball touches. A dense leaf is split into tiles on both sides, its own vectors by its
visitors, so that a task holds a bounded number of each. A pair is counted only in the first block that
has it within budget; what leaves a task are numbers of links and a forest of the pairs found there,
never the pairs of a group. Equal vectors go as one.

Where a vector is at home and which block is first must be the same in every task. A matrix product in
floating point may differ in its last bit with the number of rows, so unit vectors and the rotation are
turned into whole numbers, small enough that the product is exact in any order. What that rounds off is
far below the slack of the budgets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .components import components, forest

COSINE = 0.95
BLOCK = 8
#: Vectors that the trees are fitted on at most; vectors meant for a leaf; and for a tile of one. Visitors of a tile.
SAMPLE, LEAF, TILE, VISITORS = 16_384, 8192, 4096, 65_536
SEED = 11
#: Added to the budget of each block.
SLACK = 1e-5


@dataclass
class Tree:
    """Leaves of a block as boxes: low and high edges, [leaf, dimension]."""

    low: np.ndarray
    high: np.ndarray

    def home(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        for leaf in range(len(self.low)):
            inside = (x >= self.low[leaf]).all(1) & (x < self.high[leaf]).all(1)
            out[inside] = leaf
        return out

    def touched(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Whether the ball around each vector touches each leaf, [vector, leaf]."""
        out = np.empty((len(x), len(self.low)), bool)
        for leaf in range(len(self.low)):
            away = np.maximum(np.maximum(self.low[leaf] - x, x - self.high[leaf]), 0)
            out[:, leaf] = (away**2).sum(1) <= radius**2
        return out


def _grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    spread = x.std(axis=0) if len(x) > 1 else np.zeros(x.shape[1])
    axis = int(spread.argmax()) if len(spread) else 0
    if depth == 0 or len(x) < 32 or spread[axis] == 0:
        out.append((low, high))
        return
    cut = float(np.median(x[:, axis]))
    left = x[:, axis] < cut
    if not left.any() or left.all():
        out.append((low, high))
        return
    top, bottom = high.copy(), low.copy()
    top[axis], bottom[axis] = cut, cut
    _grow(x[left], low, top, depth - 1, out)
    _grow(x[~left], bottom, high, depth - 1, out)


class Plan:
    """Rotation, blocks, budgets and trees for vectors of one length."""

    def __init__(self, dim: int, sample: np.ndarray, vectors: int, cosine: float, leaf: int):
        rng = np.random.default_rng(SEED)
        # products of dim pairs of numbers with so many bits stay below 2**53, in which doubles are exact
        self.unit = float(1 << int((52 - np.log2(max(dim, 2))) // 2))
        self.rotation = np.rint(np.linalg.qr(rng.normal(size=(dim, dim)))[0] * self.unit)
        self.cuts = list(range(0, dim, BLOCK)) + [dim]
        self.cosine = cosine
        whole = 2 - 2 * cosine
        self.budget = np.array([whole * (b - a) / dim for a, b in zip(self.cuts, self.cuts[1:], strict=False)]) + SLACK
        depth = max(0, int(np.ceil(np.log2(max(1, vectors) / leaf))))
        self.trees = []
        turned = self.turn(sample)
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            boxes: list[tuple[np.ndarray, np.ndarray]] = []
            _grow(turned[:, a:b], np.full(b - a, -np.inf), np.full(b - a, np.inf), depth, boxes)
            self.trees.append(Tree(np.array([x for x, _ in boxes]), np.array([x for _, x in boxes])))

    def turn(self, x: np.ndarray) -> np.ndarray:
        """Rotated unit vectors, the same to the last bit whatever rows they are computed with."""
        whole = np.rint(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * self.unit)
        return (whole @ self.rotation) / (self.unit * self.unit)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distances by block, [pair, block]; the same for a pair wherever it is computed."""
        return np.add.reduceat((x - y) ** 2, self.cuts[:-1], axis=1)


def _usable(column: str) -> Column:
    values = F.col(column)
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(values, lambda x: x != 0)
    return F.coalesce(values.isNotNull() & fine & some, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


Tiles = dict[tuple[int, int, int], tuple[int, int]]


def _placed(plan: Plan, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each block: the home leaf of each vector, and which leaves up to it the vector visits."""
    for block, (a, b) in enumerate(zip(plan.cuts, plan.cuts[1:], strict=False)):
        tree, x = plan.trees[block], turned[:, a:b]
        home = tree.home(x)
        touched = tree.touched(x, float(np.sqrt(plan.budget[block])) + SLACK)
        touched[np.arange(len(x)), home] = True
        yield block, home, touched & (np.arange(len(tree.low))[None, :] <= home[:, None])


def _counts(plans: dict[int, Plan]):
    """Vectors at home in each leaf of each block, and its visitors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby(batch["vector"].map(len)):
                for block, home, visits in _placed(plans[dim], plans[dim].turn(_matrix(own["vector"]))):
                    at_home = np.bincount(home, minlength=visits.shape[1])
                    leaves = np.arange(visits.shape[1])
                    yield pd.DataFrame({"dim": dim, "block": block, "leaf": leaves, "home": at_home, "visitors": visits.sum(axis=0)})

    return rows


def _visits(plans: dict[int, Plan], tiles: Tiles):
    """Each vector at home in one row of its leaf's tiles, and as a visitor in one column of those of every leaf it visits."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby(batch["vector"].map(len)):
                own = own.reset_index(drop=True)
                vectors = _matrix(own["vector"])
                packed = np.array([v.tobytes() for v in vectors], object)
                salt = own["salt"].to_numpy(np.int64)
                for block, home, visits in _placed(plans[dim], plans[dim].turn(vectors)):
                    many = np.array([tiles.get((dim, block, leaf), (1, 1)) for leaf in range(visits.shape[1])])
                    at = np.arange(len(own))
                    at, other = _each(at, many[home, 1])
                    yield _rows(own, packed, dim, block, home[at], salt[at] % many[home[at], 0], other, True, at)
                    at, leaf = np.nonzero(visits)
                    place, other = _each(np.arange(len(at)), many[leaf, 0])
                    at, leaf = at[place], leaf[place]
                    yield _rows(own, packed, dim, block, leaf, other, salt[at] % many[leaf, 1], False, at)

    return rows


def _each(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row so many times, and which time it is."""
    return np.repeat(rows, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _rows(own, packed, dim, block, leaf, tile, column, home, at) -> pd.DataFrame:
    rows = own.iloc[at]
    return pd.DataFrame(
        {"dim": dim, "block": block, "leaf": leaf, "tile": tile, "column": column, "home": home, "rep": rows["rep"].to_numpy(), "n": rows["n"].to_numpy(), "vector": packed[at]}
    )


VISITS = "dim int, block int, leaf int, tile int, column int, home boolean, rep bigint, n bigint, vector binary"
FOUND = "a bigint, b bigint, links bigint"


def _meet(plans: dict[int, Plan]):
    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a tile's own vectors with its visitors: numbers of links, and a forest."""
        dim, block = int(rows["dim"].iloc[0]), int(rows["block"].iloc[0])
        plan = plans[dim]
        here, there = rows[rows["home"]], rows[~rows["home"]]
        sides = []
        for side in (here, there):
            raw = np.frombuffer(b"".join(side["vector"]), np.float64).reshape(-1, dim)
            sides.append((side["rep"].to_numpy(), side["n"].to_numpy(), raw, plan.turn(raw) if len(raw) else raw))
        (rep_a, n_a, raw_a, turn_a), (rep_b, n_b, raw_b, turn_b) = sides
        if not len(rep_a) or not len(rep_b):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        lo, hi = plan.cuts[block], plan.cuts[block + 1]
        # a product of these is minus half the squared distance
        x, y = turn_a[:, lo:hi], turn_b[:, lo:hi]
        left = np.hstack([x, -0.5 * (x * x).sum(1)[:, None], np.ones((len(x), 1))]).astype(np.float32)
        right = np.hstack([y, np.ones((len(y), 1)), -0.5 * (y * y).sum(1)[:, None]]).astype(np.float32)
        least = np.float32(-plan.budget[block] / 2 - 1e-5)
        norm_a, norm_b = np.sqrt((raw_a * raw_a).sum(1)), np.sqrt((raw_b * raw_b).sum(1))
        own_leaf = plan.trees[block].home(y) == int(rows["leaf"].iloc[0])
        links: dict[str, np.ndarray] = {"a": np.zeros(len(rep_a), np.int64), "b": np.zeros(len(rep_b), np.int64)}
        trees = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        step = max(1, 4_000_000 // len(y))
        for start in range(0, len(x), step):
            i, j = np.nonzero(left[start : start + step] @ right.T >= least)
            i += start
            # within a leaf both meet twice: the smaller one at home counts
            fine = ~own_leaf[j] | (rep_a[i] < rep_b[j])
            i, j = i[fine], j[fine]
            for part in range(0, len(i), 200_000):
                p, q = i[part : part + 200_000], j[part : part + 200_000]
                cosine = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / (norm_a[p] * norm_b[q])
                good = cosine >= plan.cosine
                p, q = p[good], q[good]
                if not len(p):
                    continue
                first = (plan.near(turn_a[p], turn_b[q]) <= plan.budget).argmax(axis=1) == block
                p, q = p[first], q[first]
                links["a"] += np.bincount(p, n_b[q], minlength=len(rep_a)).astype(np.int64)
                links["b"] += np.bincount(q, n_a[p], minlength=len(rep_b)).astype(np.int64)
                trees = forest(np.concatenate([trees["a"], rep_a[p]]), np.concatenate([trees["b"], rep_b[q]]))
        out = [trees.assign(links=None)]
        for side, reps in (("a", rep_a), ("b", rep_b)):
            has = np.flatnonzero(links[side])
            out.append(pd.DataFrame({"a": reps[has], "b": None, "links": links[side][has]}))
        return pd.concat(out).astype({"a": "Int64", "b": "Int64", "links": "Int64"})

    return tile


def link_components(table: DataFrame, cosine: float = COSINE, leaf: int = LEAF, tile: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of table (vec_id, embedding).

    Rows link when the cosine of their vectors, in double precision, is `cosine` or more. A vector
    that is null, zero or empty, or has a null or non-finite component, links with nothing, and
    vectors of different lengths do not either. n_links counts rows, equal ones too. A row without
    vec_id links with nothing, has no component and is not kept. Rows with one vec_id are told apart
    by their vectors alone. Other columns are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = _usable("vector") & F.col("vec_id").isNotNull()
    keys = [F.when(usable, F.xxhash64("vector")).alias("key_1"), F.when(usable, F.xxhash64(F.lit(1), "vector", F.lit(2))).alias("key_2")]
    members = materialise(rows.select("vec_id", *keys))
    classes = rows.where(usable).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # one row for each vec_id: a second vector under the same id is a class of its own
    classes = materialise(classes.select("rep", "n", "vector", F.xxhash64("vector").alias("key_1"), F.xxhash64(F.lit(1), "vector", F.lit(2)).alias("key_2")))
    lengths = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plans: dict[int, Plan] = {}
    for dim, n in lengths.items():
        sample = classes.where(F.size("vector") == dim).orderBy("key_1", "key_2").limit(SAMPLE).select("vector").toPandas()
        plans[dim] = Plan(dim, _matrix(sample["vector"]), n, cosine, leaf)
    shared = classes.select("rep", "n", "vector", F.pmod(F.xxhash64(F.lit(3), "vector"), F.lit(1 << 40)).alias("salt"))
    if not plans:
        found = spark.createDataFrame([], FOUND)
    else:
        sizes = shared.select("vector").mapInPandas(_counts(plans), "dim int, block int, leaf int, home bigint, visitors bigint")
        sizes = sizes.groupBy("dim", "block", "leaf").agg(F.sum("home").alias("home"), F.sum("visitors").alias("visitors"))
        tiles = {
            (r["dim"], r["block"], r["leaf"]): (max(1, -(-r["home"] // tile)), max(1, -(-r["visitors"] // visitors))) for r in sizes.collect()
        }
        visits = shared.mapInPandas(_visits(plans, tiles), VISITS)
        found = materialise(visits.groupBy("dim", "block", "leaf", "tile", "column").applyInPandas(_meet(plans), FOUND))
    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"))
    named = (
        classes.select("rep", "n", "key_1", "key_2")
        .join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key_1", "key_2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("group"))
    )
    component = F.coalesce("group", "vec_id")
    return members.join(named, ["key_1", "key_2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
