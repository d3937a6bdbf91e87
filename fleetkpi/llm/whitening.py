"""Whitening of embeddings; the eigenvectors come from contour integrals.

Sums and products of the vectors are added up in whole numbers on the executors, so the covariance is
exact up to its last rounding, whichever tasks had which rows. Its side is the length of a vector, and
from there on only matrices of that side are worked on at the driver.

The spectrum is cut into intervals around numerically separate eigenvalues. A quadrature over a circle
through the ends of an interval solves shifted complex systems and projects trial vectors onto the
eigenvectors inside (FEAST); Rayleigh-Ritz extracts them and the projection is repeated until the
residuals are down to rounding. The covariance less a shift has as many negative pivots as there are
eigenvalues below the shift (inertia); counted at both ends of an interval, they say how many must be
found there, and a wrong number is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

MOST = 8
SCALE, SHIFT = 1024, 100_000
#: Points of the quadrature on the upper half of a circle, and projections of an interval at most.
POINTS, ROUNDS = 8, 60
#: Eigenvalues nearer to each other than this part of the largest one are found together.
SEPARATE = 1e-6
#: Whole numbers are exact in double up to here.
EXACT = 1 << 53


# ---------------------------------------------------------------- spectrum of one matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a similar matrix, by reflections; it has the same inertia under any shift."""
    a = matrix.astype(np.float64, copy=True)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.sqrt((x * x).sum())
        if length == 0 or not x[1:].any():
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.sqrt((x * x).sum())
        block = a[k + 1 :, k + 1 :]
        p = block @ x
        q = p - (x @ p) * x
        block -= 2 * np.outer(x, q) + 2 * np.outer(q, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(diagonal: np.ndarray, side: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each shift: negative pivots of the shifted tridiagonal matrix."""
    shifts = np.asarray(shifts, np.float64)
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - side[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def located(diagonal: np.ndarray, side: np.ndarray) -> np.ndarray:
    """All eigenvalues, falling, by bisection on inertia."""
    n = len(diagonal)
    around = np.abs(np.concatenate(([0], side))) + np.abs(np.concatenate((side, [0])))
    low = np.full(n, (diagonal - around).min())
    high = np.full(n, (diagonal + around).max())
    margin = np.finfo(float).eps * max(1e-300, np.abs([low[0], high[0]]).max()) * n
    low, high = low - margin, high + margin
    rank = np.arange(n)
    for _ in range(80):
        middle = (low + high) / 2
        less = below(diagonal, side, middle) <= rank
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return ((low + high) / 2)[::-1]


def intervals(values: np.ndarray, most: int) -> list[tuple[float, float]]:
    """Ends, within gaps, of intervals that hold the `most` largest of falling eigenvalues, and their companions."""
    top = max(abs(values[0]), abs(values[-1]))
    gaps = values[:-1] - values[1:]
    out, first = [], 0
    while first < min(most, len(values)):
        last = first
        while last < len(gaps) and gaps[last] <= SEPARATE * top:
            last += 1
        above = gaps[first - 1] if first else np.inf
        under = gaps[last] if last < len(gaps) else np.inf
        reach = min(above, under)
        reach = (reach if np.isfinite(reach) else max(top, np.finfo(float).tiny)) / 2
        out.append((float(values[last] - reach), float(values[first] + reach)))
        first = last + 1
    return out


def projected(matrix: np.ndarray, low: float, high: float, expected: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues within (low, high), falling, and unit eigenvectors as columns.

    `expected` is their number by inertia. ValueError if another number is found.
    """
    n = len(matrix)
    width = min(n, expected + max(4, expected // 2))
    y = np.random.default_rng(seed).normal(size=(n, width))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (nodes + 1)
    points = np.exp(1j * angles)
    scale = max(np.abs(matrix).sum(axis=1).max(), np.finfo(float).tiny)
    best = None
    for _ in range(ROUNDS):
        filtered = np.zeros((n, width))
        for point, weight in zip(points, weights, strict=True):
            # half of the circle twice: the other half is the conjugate
            filtered += (weight / 2) * (radius * point * np.linalg.solve((centre + radius * point) * np.eye(n) - matrix, y.astype(complex))).real
        basis = np.linalg.qr(filtered)[0]
        small = basis.T @ matrix @ basis
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        y = basis @ turn
        inside = (ritz > low) & (ritz < high)
        values, vectors = ritz[inside][::-1], y[:, inside][:, ::-1]
        if len(values) == expected:
            residual = np.abs(matrix @ vectors - vectors * values).max(initial=0) / scale
            if best is not None and residual >= best[0] / 2 and best[0] < 1e-12:
                break
            if best is None or residual < best[0]:
                best = (residual, values, vectors)
    if best is None or best[0] > 1e-11:
        raise ValueError(f"{expected} eigenvalues lie between {low} and {high}, and the projection did not find them")
    return best[1], best[2]


def largest(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, with unit eigenvectors as columns.

    The largest entry of each vector is positive. Eigenvalues that are zero up to rounding are left out.
    """
    scale = np.abs(matrix).max(initial=0.0)
    if not scale:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled = matrix / scale
    diagonal, side = tridiagonal(scaled)
    values, vectors, total = [], [], 0
    for low, high in intervals(located(diagonal, side), most):
        under, upto = below(diagonal, side, np.array([low, high]))
        own, columns = projected(scaled, low, high, int(upto - under))
        values.append(own)
        vectors.append(columns)
        total += len(own)
        if total != len(matrix) - under:
            raise ValueError(f"{total} eigenvalues found above {low}, and {len(matrix) - under} are there")
    found, columns = np.concatenate(values)[:most], np.hstack(vectors)[:, :most]
    solid = found > len(matrix) * np.finfo(float).eps * found[0]
    found, columns = found[solid], columns[:, solid]
    signs = np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])])
    return found * scale, columns * signs


# ---------------------------------------------------------------- sums over all vectors


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum, least and largest of each dimension over a task's vectors."""
    total = low = high = None
    for batch in batches:
        if len(batch):
            x = _vectors(batch["x"])
            least, most = x.min(axis=0), x.max(axis=0)
            exact = max(abs(int(least.min())), abs(int(most.max()))) * len(x) < 1 << 62
            own = (x if exact else x.astype(object)).sum(axis=0).astype(object)
            total = own if total is None else total + own
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
    if total is not None:
        yield pd.DataFrame({"place": np.arange(len(total)), "total": [str(int(t)) for t in total], "low": low, "high": high})


def _products(centre: np.ndarray, reach: int, n: int):
    """Products of all pairs of dimensions, of the distances from `centre`, over a task's vectors."""
    step = EXACT // max(1, reach * reach)
    kind = np.int64 if n * reach * reach < 1 << 62 else object

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            y = _vectors(batch["x"]) - centre
            if step:
                # no sum of so many products passes what double holds exactly
                parts = [y[at : at + step].astype(np.float64) for at in range(0, len(y), step)]
                own = sum((p.T @ p).astype(np.int64).astype(kind) for p in parts)
            else:
                own = y.astype(object).T @ y.astype(object)
            total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "products": [[str(int(v)) for v in row] for row in total]})

    return rows


def _whitened(batch: pd.Series, centre: np.ndarray, rest: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return ((_vectors(batch) - centre) - rest) @ basis


def _moments(centre: np.ndarray, rest: np.ndarray, basis: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                w = np.hstack([_whitened(batch["x"], centre, rest, basis), np.ones((len(batch), 1))])
                a, b = np.indices((w.shape[1], w.shape[1]))
                yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "v": (w.T @ w).ravel()})

    return rows


def _scored(centre: np.ndarray, rest: np.ndarray, basis: np.ndarray, sums: list[int], n: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offset = np.array([n * int(c) - s for c, s in zip(centre, sums, strict=True)], object)
        for batch in batches:
            if not len(batch):
                continue
            y = _vectors(batch["x"]) - centre
            reach = n * int(np.abs(y).max(initial=0)) + max(abs(int(o)) for o in offset)
            if reach * reach * y.shape[1] < 1 << 62:
                away = (n * y + offset.astype(np.int64)) ** 2
            else:
                away = (n * y.astype(object) + offset) ** 2
            deviation = [str(int(v)) for v in away.sum(axis=1)]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": deviation, "w": list(_whitened(batch["x"], centre, rest, basis))})

    return rows


def whitened(table: DataFrame, most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error of table (vec_id, embedding).

    A component c of a vector counts as floor(scale * c) + shift. The fit list is all vectors that are not
    null or empty and hold no null or non-finite entry; of several lengths the most frequent one counts,
    the longer one of equally frequent ones. Other rows are left out. Each remaining row gives a row for
    each of the `most` largest eigenvalues of the covariance (divisor n), fewer if the vectors are shorter
    or the covariance has a lower rank: what has no variance cannot be whitened. Of equal eigenvalues any
    basis may be taken, the same for all rows. Repeated or null vec_ids make no difference. Other columns
    are ignored; components too large for a long are an error. An empty table, a single vector or vectors that are all equal give an empty result.
    """
    spark = table.sparkSession
    shape = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(values, lambda c: F.floor(F.lit(float(scale)) * c).cast("bigint") + F.lit(shift))
    rows = table.where(F.coalesce(fine & (F.size("embedding") > 0), F.lit(False)))
    rows = materialise(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")))
    length = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if length is None:
        return spark.createDataFrame([], shape)
    n, dim = length["n"], length["length"]
    rows = rows.where(F.size("x") == dim)

    found = rows.select("x").mapInPandas(_sums, "place int, total string, low bigint, high bigint")
    found = found.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(found.collect(), key=lambda r: r["place"])  # a row a dimension
    sums = [int(r["total"]) for r in found]
    # whole numbers next to the mean: what is multiplied is centred, and the rest is a fraction below one
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    reach = max(max(r["high"] - int(c), int(c) - r["low"]) for r, c in zip(found, centre, strict=True))

    found = rows.select("x").mapInPandas(_products(centre, reach, n), "place int, products array<string>")
    found = found.select("place", F.posexplode("products").alias("other", "v")).groupBy("place", "other")
    found = found.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("other", "v"))).alias("row"))
    products = {r["place"]: [int(v["v"]) for v in r["row"]] for r in found.collect()}  # dim x dim numbers
    left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    covariance = np.array([[(n * products[i][j] - left[i] * left[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    trace = sum(n * products[i][i] - left[i] ** 2 for i in range(dim)) / (n * n)
    eigenvalues, vectors = largest(covariance, most)
    if not len(eigenvalues):
        return spark.createDataFrame([], shape)
    rest = np.array([v / n for v in left])
    basis = vectors / np.sqrt(eigenvalues)

    moments = rows.select("x").mapInPandas(_moments(centre, rest, basis), "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    k = len(eigenvalues)
    second = np.zeros((k + 1, k + 1))
    for r in moments.collect():
        second[r["a"], r["b"]] = r["v"] / n
    error = float(np.abs(second[:k, :k] - np.outer(second[:k, k], second[k, :k]) - np.eye(k)).max())

    scored = rows.mapInPandas(_scored(centre, rest, basis, sums, n), "vec_id bigint, deviation string, w array<double>")
    explained = F.array(*(F.lit(float(e / trace)) for e in eigenvalues))
    return scored.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
