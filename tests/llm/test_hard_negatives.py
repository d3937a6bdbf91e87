"""Hard negatives against brute force in whole numbers, and odd input."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetkpi.llm import hard_negatives as hn

TABLE = "vec_id bigint, embedding array<float>, label int, row string, vector string"


def brute(rows, anchor, scale=256, positives=5, negatives=5, low=80, high=100):
    fine = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    out = []
    for a in fine:
        if not anchor(a[0]):
            continue
        scored = [(sum(x * y for x, y in zip(a[1], b[1], strict=True)), b[0], b[2]) for b in fine if b is not a and len(b[1]) == len(a[1])]
        best = sorted(((-s, i) for s, i, l in scored if l == a[2]))[:positives]
        for s, p in best:
            s = -s
            near = sorted((-t, i) for t, i, l in scored if l != a[2] and low * s <= 100 * t <= high * s)[:negatives]
            out += [(a[0], p, rank, i, s, -t) for rank, (t, i) in enumerate(near, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(n, dim, seed, near=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    x = centre[rng.integers(0, 4, n)] + near * rng.normal(size=(n, dim))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim, tiles", [(3, (4, 16)), (64, (100, 40)), (64, (8192, 8192))])
def test_equals_brute_force_in_any_tiling(spark, dim, tiles):
    rows = vectors(220, dim, dim)
    rows += [(1000 + i, v, (label + 1) % 3) for i, v, label in rows[:40]]  # equal scores
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], TABLE).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 20 == 0, tile_anchors=tiles[0], tile_rows=tiles[1])
    assert found(got) == brute(rows, lambda i: i % 20 == 0) != []


def test_odd_rows(spark):
    v = [0.5, -0.25, 0.125]
    rows = vectors(60, 3, 9) + [
        (100, None, 1), (101, [], 1), (102, [None, 0.1, 0.2], 1), (103, [float("nan"), 0.1, 0.2], 0), (104, [float("inf"), 0.1, 0.2], 0),
        (105, v, None), (None, v, 1), (106, [0.5, 0.5], 0), (107, [0.5, 0.5], 1), (120, [0.5, 0.4], 0), (108, [0.0, 0.0, 0.0], 2), (140, [0.0, 0.0, 0.0], 1),
        (20, v, 1), (20, v, 1), (109, v, 1), (110, v, 2), (111, v, 2),
    ]
    df = spark.createDataFrame([(i, e, label, "x", "y") for i, e, label in rows], TABLE)
    assert found(hn.hard_negatives(df, F.col("vec_id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)
    assert hn.hard_negatives(spark.createDataFrame([], TABLE), F.col("vec_id") % 20 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(None).cast("boolean")).columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]


def test_residues_give_exact_signed_scores():
    rng = np.random.default_rng(2)
    for dim, size in ((1, 5), (7, 300), (64, 40_000), (1500, 2000), (3000, 100_000)):
        x, y = (rng.integers(-size, size + 1, (9, dim)) for _ in range(2))
        x[0], y[0], y[1] = size, size, -size  # the largest scores there can be
        bound = int(dim * size * size)
        system = hn.Residues(dim, bound)
        assert all(2 * bound < system.product < 1 << 63 for _ in system.primes) and len(set(system.primes)) == len(system.primes)
        assert all(system.piece * (p // 2) ** 2 <= hn.EXACT for p in system.primes)
        got = system.scores(system.parts(x), system.parts(y))
        assert (got.astype(object) == x.astype(object) @ y.astype(object).T).all()


def test_too_large_vectors_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e10], 0, None, None), (1, [1e10], 0, None, None)], TABLE)
    with pytest.raises(ValueError, match="beyond"):
        hn.hard_negatives(df, F.col("vec_id") == 0)


def test_the_registered_query_equals_its_sql(spark, database):
    from fleetkpi.llm import queries

    got = sorted(tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(database.sql(queries.SQL["op12_hard_negatives"]).fetchall()) != []
