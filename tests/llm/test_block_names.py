"""Block naming against equal texts found by brute force, and odd input."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetkpi.llm import block_names

DOCS = "doc_id bigint, text string, name string, row_ string"


def expected(rows):
    """Rows (doc_id, keep_id, group_size, text_sha256) and, for each text, whether one row of the best doc_id stays."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out, {hashlib.sha256(t.encode()).hexdigest(): max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}


def check(df, rows):
    found = df.collect()
    want, keeps = expected(rows)
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=order) == sorted(want, key=order)
    kept = [(r.text_sha256, r.doc_id) for r in found if r.kept]
    assert sorted(kept) == sorted(keeps.items())


def texts():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ab é€😀\n"), n))
    base = [word(int(n)) for n in rng.integers(0, 90, 60)]
    # blocks in another order, a block more, one character changed, a missing last block
    base += ["aaaabbbb", "bbbbaaaa", "aaaa", "aaaaaaaa", "aaaabbbbaaaa", "aaaabbbbaaaabbbb", "aaaabbbbaaaabbbc", "", "a" * 100, "a" * 101]
    return [(int(i), base[int(j)]) for i, j in enumerate(rng.integers(0, len(base), 220))]


@pytest.mark.parametrize("size", [8, 4096])
def test_groups_are_those_of_equal_texts(spark, size):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS).repartition(5)
    check(block_names.exact_duplicates(df, size), rows)


def test_odd_rows(spark):
    long = "word é " * 40_000
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (None, "y"), (2, None), (3, ""), (4, " "), (5, long), (6, long), (7, long + "."), (-3, "x")]
    check(block_names.exact_duplicates(spark.createDataFrame([(i, t, "n", "r") for i, t in rows], DOCS)), rows)
    nothing = block_names.exact_duplicates(spark.createDataFrame([], DOCS))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_names_are_ranks_whatever_the_partitions(spark):
    rows = [(i, t, None, None) for i, t in texts()]
    seen = []
    for parts in (1, 7):
        named = block_names.identities(spark.createDataFrame(rows, DOCS).repartition(parts).select("doc_id", "text"), 16)
        seen.append(sorted((r.doc_id, r.level, r.name) for r in named.collect()))
    assert seen[0] == seen[1]
    single = spark.createDataFrame([(i, t) for i, t in enumerate("bca")], "doc_id bigint, text string")
    assert {r.doc_id: (r.level, r.name) for r in block_names.identities(single).collect()} == {0: (0, 2), 1: (0, 3), 2: (0, 1)}


def test_equal_keys_of_different_blocks_are_noticed(spark, monkeypatch):
    strong, tried = block_names.block_keys, []

    def weak(block, attempt):
        tried.append(attempt)
        if attempt == 0:
            return F.struct((F.length(block) % 2).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"))
        return strong(block, attempt)

    monkeypatch.setattr(block_names, "block_keys", weak)
    rows = texts()
    check(block_names.exact_duplicates(spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS), 16), rows)
    assert max(tried) == 1


def test_main_path_is_native(spark):
    rows = [(i, t, None, None) for i, t in texts()[:20]]
    plan = block_names.exact_duplicates(spark.createDataFrame(rows, DOCS), 32)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_text_that_most_rows_have_is_dealt_over_salts(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(900)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)
    check(block_names.exact_duplicates(df), rows)
    salts = df.select(block_names.salt(df, "doc_id").alias("s")).groupBy("s").count().collect()
    assert len(salts) == 4 and max(r["count"] for r in salts) < 300
