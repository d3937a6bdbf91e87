"""The stages of corpus_pipeline.py one by one against brute force, on odd rows and on an empty table."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from fleetkpi.llm import bpe, quality, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, copies string, key string, row string"
STAGES = dict(corpus_pipeline.STAGES)


def rows():
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(900)]
    out = []
    for i in range(40):
        base = [str(w) for w in rng.choice(words, int(rng.integers(8, 120)))]
        near = base[: len(base) // 2] + ["x"] + base[len(base) // 2 + 1 :]
        for text in [base, near][: 1 + i % 2]:
            out.append((len(out) + 100, " ".join(text), "en", f"s{i % 4}" if i % 9 else None))
    text = "one two three four five six seven"
    out += [(7, text, "en", "s0"), (7, text, "en", "s0"), (None, text, "de", None), (7, "another text of some words here", "en", "s1")]
    out += [(None, "only without a name at all", "en", "s1")] * 2 + [(8, None, None, None), (9, "", "en", "s0"), (9, "", "en", "s0"), (10, " \n ", "en", "s2")]
    out += [(11, "long " * 30_000 + "end", "en", "s3"), (12, "Word", "en", "s1"), (13, "wORD", "en", "s1")]
    return [(*r, len(r[1] or ""), "a", "b", "c", "d") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def plain(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def test_stages_are_these():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near duplicates", "mixing", "bpe"]


def test_one_row_of_each_group_stays(spark, docs):
    own = rows()
    sets = [shingles(r[1]) for r in own]
    group = list(range(len(own)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in zip(own, group):
        best[g] = min(best.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    got = plain(STAGES["near duplicates"](spark, docs, SF_DIR))
    assert sum(got.values()) == len(set(group)) < len(own) - 10
    left = Counter((r[0] is None, r[0] or 0) for r in got.elements())
    assert left == Counter(best.values())
    assert set(got) <= {r[:5] for r in own}
    # two texts under one doc_id are judged apart, repeated rows are not
    assert sorted(r[1] for r in got.elements() if r[0] == 7) == ["another text of some words here", "one two three four five six seven"]


def test_mixing_repeats_rows_by_their_own_text(spark, docs):
    own = [r[:5] for r in rows()]
    got = plain(STAGES["mixing"](spark, docs, SF_DIR))
    assert set(got) <= set(own)
    there = Counter(own)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    for r, n in there.items():
        assert got[r] % n == 0 and got[r] <= 3 * n and (size(r) or got[r] == n)
    total, taken = sum(size(r) * n for r, n in there.items()), sum(size(r) * n for r, n in got.items())
    longest = max(size(r) for r in own)
    assert abs(total - taken) <= longest + total / 100
    assert got == plain(STAGES["mixing"](spark, docs.repartition(7), SF_DIR))


def test_encoding_is_the_library_s(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_padding()
    library.no_truncation()
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in STAGES["bpe"](spark, docs, SF_DIR).collect())
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows()]
    assert got == Counter((d, len(x), tuple(x)) for d, x in ids)


def test_models_decide_row_by_row(spark, docs, monkeypatch):
    toxic, poor = F.col("text").contains("w1"), F.col("text").contains("w2")
    marked = lambda test, name: lambda df, model: df.withColumn(name, F.coalesce(test, F.lit(False)).cast("int"))
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "train", lambda *tables: None)
    monkeypatch.setattr(toxicity, "score", marked(toxic, "predicted"))
    monkeypatch.setattr(quality, "score", marked(poor, "poor"))
    monkeypatch.setattr(quality, "accepted", lambda: F.col("poor") == 0)
    for stage, word in (("toxicity", "w1"), ("quality", "w2")):
        assert plain(STAGES[stage](spark, docs, SF_DIR)) == Counter(r[:5] for r in rows() if word not in (r[1] or ""))


def test_toxicity_on_the_held_out_fifth(spark):
    """The stage drops most toxic documents that it has not learned from, and keeps nearly all others."""
    folder = "/root/testdata/sf0.1"
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(held).select("doc_id", "toxic")
    documents = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id")
    kept = STAGES["toxicity"](spark, documents, folder).select("doc_id", F.lit(1).alias("kept"))
    known = labels.join(documents.select("doc_id"), "doc_id", "left_semi").join(kept, "doc_id", "left")
    counts = {(r.toxic, r.kept): r["count"] for r in known.na.fill(0, ["kept"]).groupBy("toxic", "kept").count().collect()}
    toxic, clean = (counts[t, 0] + counts[t, 1] for t in (1, 0))
    assert toxic > 80 and counts[1, 0] >= 0.75 * toxic and counts[0, 1] >= 0.97 * clean


def test_workers_get_texts_in_small_batches(spark):
    """The executor and its Python workers hold a few MB of text at a time, not 10,000 texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    many = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("some text "), 1000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    try:
        spark.conf.set(key, str(256 << 20))
        STAGES["bpe"](spark, spark.createDataFrame([], DOCS), SF_DIR)
        assert many.mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0] < 5 << 20
        spark.conf.set(key, "1000")
        STAGES["bpe"](spark, spark.createDataFrame([], DOCS), SF_DIR)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_empty_tables_stay_empty(spark, docs, monkeypatch):
    empty = docs.limit(0)
    for name in ("near duplicates", "mixing", "bpe"):
        assert STAGES[name](spark, empty, SF_DIR).count() == 0
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.train(documents, quality.graded(labels))
    assert quality.score(empty.select(*corpus_pipeline.COLUMNS), model).count() == 0
