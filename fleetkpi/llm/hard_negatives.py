"""Hard negatives by integer scores, multiplied modulo small primes.

Vectors of integers are scored by their inner products. A matrix product in float32 is exact while no
sum passes 2**24, so each component is replaced by its residue modulo a prime, taken between -p/2 and
p/2; as many primes are multiplied out as the largest possible score needs, and the exact signed score
comes back by Chinese remaindering.

The stated anchors meet all rows in tiles: anchors and rows are dealt into parts of a bounded size by
hash, whatever their labels, and each pair of parts is a group of its own. A tile hands on the best
few rows of each anchor; windows over an anchor choose among those of its tiles. Positives are found
first; a second round over the tiles finds, for each positive, the best rows of other labels within
the window of scores that the positive's own score opens.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Anchors and rows of a tile, about.
TILE_ANCHORS, TILE_ROWS = 8192, 8192
#: Sums in float32 are exact up to here.
EXACT = 1 << 24
#: Squares of vectors stay below, so that the product of the primes stays within 64 bits.
LARGEST = float(1 << 50)
#: Dimensions that are multiplied at once; longer vectors are added up piece by piece.
PIECE = 1024
#: Scores that are held at a time in a tile.
SCORES = 1 << 21

POSITIVES = "anchor bigint, anchor_id bigint, other bigint, other_id bigint, score bigint"
NEGATIVES = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, other bigint, other_id bigint, score bigint"


class Residues:
    """Primes for vectors of a length whose scores stay within `bound`, products and their reconstruction."""

    def __init__(self, dim: int, bound: int):
        self.piece = max(1, min(dim, PIECE))
        largest = 2 * math.isqrt(EXACT // self.piece) + 1
        self.primes: list[int] = []
        self.product = 1
        candidate = largest
        while self.product <= 2 * bound:
            if candidate < 3:
                raise ValueError(f"no primes for scores of {bound}")
            if all(candidate % d for d in range(2, math.isqrt(candidate) + 1)):
                self.primes.append(candidate)
                self.product *= candidate
            candidate -= 1

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Residues between -p/2 and p/2 of integer vectors, one float32 matrix a prime."""
        out = []
        for p in self.primes:
            rest = np.mod(vectors, p)
            rest[rest > p // 2] -= p
            out.append(rest.astype(np.float32))
        return out

    def scores(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Exact inner products [left, right] as 64-bit integers."""
        total: np.ndarray | None = None
        weight = 1
        for p, a, b in zip(self.primes, left, right, strict=True):
            rest = np.zeros((len(a), len(b)), np.int64)
            for at in range(0, a.shape[1], self.piece):
                rest += (a[:, at : at + self.piece] @ b[:, at : at + self.piece].T).astype(np.int64)
            if total is None:
                total = np.mod(rest, p)
            else:
                # the digit of this prime in mixed radix
                digit = np.mod((rest - total) % p * pow(weight, -1, p), p)
                total += digit * weight
            weight *= p
        if total is None:
            return np.zeros((len(left[0]) if left else 0, len(right[0]) if right else 0), np.int64)
        total[total > self.product // 2] -= self.product
        return total


def quantised(column: Column, scale: int) -> Column:
    """Integers floor(scale * x) of each component, taken as double."""
    return F.transform(column.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))


def _fine(column: Column) -> Column:
    values = column.cast("array<double>")
    each = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & each, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _best(scores: np.ndarray, among: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores among those given; ties by smaller id, then by row."""
    if len(among) > most:
        own = scores[among]
        least = np.partition(own, len(own) - most)[len(own) - most]
        among = among[own >= least]
    return among[np.lexsort((rows[among], ids[among], -scores[among]))[:most]]


def _tiles(anchors: pd.DataFrame, rows: pd.DataFrame, bound: int):
    """Anchors one by one with their scores against all rows of the tile."""
    left, right = _matrix(anchors["vector"]), _matrix(rows["vector"])
    if not len(left) or not len(right):
        return
    system = Residues(left.shape[1], bound)
    parts = system.parts(right)
    step = max(1, SCORES // len(right))
    for at in range(0, len(left), step):
        scores = system.scores(system.parts(left[at : at + step]), parts)
        for i in range(len(scores)):
            yield at + i, scores[i]


def _positives(bound: int, most: int):
    def tile(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The best rows of an anchor's label in this tile."""
        ids, own, labels = (rows[c].to_numpy() for c in ("vec_id", "row", "label"))
        by_label = {label: np.flatnonzero(labels == label) for label in np.unique(labels)}
        out = []
        nothing = np.zeros(0, np.int64)
        names = anchors[["row", "vec_id", "label"]].to_numpy()
        for i, scores in _tiles(anchors, rows, bound):
            row, vec_id, label = names[i].tolist()
            among = by_label.get(label, nothing)
            among = among[own[among] != row]
            best = _best(scores, among, ids, own, most)
            out.append(pd.DataFrame({"anchor": row, "anchor_id": vec_id, "other": own[best], "other_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["anchor", "anchor_id", "other", "other_id", "score"], dtype="int64")

    return tile


def _negatives(bound: int, most: int, low: int, high: int):
    columns = [c.split()[0] for c in NEGATIVES.split(", ")]

    def tile(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """For each positive of an anchor the best rows of other labels within its window in this tile."""
        ids, own, labels = (rows[c].to_numpy() for c in ("vec_id", "row", "label"))
        by_label = {label: np.flatnonzero(labels != label) for label in anchors["label"].unique()}
        out = []
        names, wanted = anchors[["row", "vec_id", "label"]].to_numpy(), anchors["positives"].to_numpy()
        for i, scores in _tiles(anchors, rows, bound):
            row, vec_id, label = names[i].tolist()
            others = by_label[label]
            theirs = scores[others]
            for positive in wanted[i]:
                score = positive["score"]
                # low * score <= 100 * s <= high * score, in whole numbers
                first, last = -(-low * score // 100), high * score // 100
                best = _best(scores, others[(theirs >= first) & (theirs <= last)], ids, own, most)
                if len(best):
                    out.append(
                        pd.DataFrame(
                            {"anchor": row, "anchor_id": vec_id, "positive": positive["other"], "positive_id": positive["other_id"],
                             "positive_score": score, "other": own[best], "other_id": ids[best], "score": scores[best]}
                        )
                    )
        return pd.concat(out) if out else pd.DataFrame(columns=columns, dtype="int64")

    return tile


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    table: DataFrame,
    anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    tile_anchors: int = TILE_ANCHORS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of table (vec_id, embedding, label).

    A component x counts as floor(scale * x). Anchors are the rows that `anchor` holds for. An anchor's
    positives are the first `positives` other rows of its label by score, ties by smaller vec_id; for each
    of them the first `negatives` rows of other labels follow whose score lies between low and high
    percent of the positive's. Rows without vec_id or label, or with a null or empty vector or a null or
    non-finite component take no part, and vectors of different lengths do not meet. Rows that repeat a
    vec_id are rows of their own. Vectors whose square is 2**50 or more are an error. Other columns are ignored; an empty
    table, or one without anchors, gives an empty result.
    """
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = table.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.when(_fine(F.col("embedding")), quantised(F.col("embedding"), scale)).alias("vector"),
    )
    # the row numbers are read from what this wrote ever after
    rows = materialise(rows.where("vec_id is not null and label is not null and vector is not null"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    facts = rows.select("is_anchor", square.alias("square")).agg(F.max("square").alias("square"), F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors")).first()
    if not facts["anchors"]:
        return table.sparkSession.createDataFrame([], shape)
    # no inner product is larger than the largest square, which is off by rounding at most
    if facts["square"] >= LARGEST:
        raise ValueError(f"scores of {facts['square']} are beyond 2**50")
    bound = int(facts["square"] * (1 + 1e-9)) + 1
    sides = [max(1, -(-n // size)) for n, size in ((facts["anchors"], tile_anchors), (facts["n"], tile_rows))]
    dim, part = F.size("vector").alias("dim"), lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["dim", "i", "j"]
    right = rows.select("row", "vec_id", "label", "vector", dim, part(sides[1]).alias("j"), every(sides[0]).alias("i")).groupBy(*keys)
    chosen = rows.where("is_anchor").select(*(F.col(c).alias(c) for c in ("row", "vec_id", "label", "vector")))

    def placed(own: DataFrame):
        return own.select("*", dim, part(sides[0]).alias("i"), every(sides[1]).alias("j")).groupBy(*keys)

    found = placed(chosen).cogroup(right).applyInPandas(_positives(bound, positives), POSITIVES)
    best = materialise(_first(found, ["anchor"], positives).drop("rank"))
    windows = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("other", "other_id", "score")).alias("positives"))
    found = placed(chosen.join(windows, "row")).cogroup(right).applyInPandas(_negatives(bound, negatives, low, high), NEGATIVES)
    return _first(found, ["anchor", "positive"], negatives).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
