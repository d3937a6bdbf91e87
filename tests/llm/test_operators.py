"""The operators for training data against brute force, the libraries they stand in for, and odd input."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from fleetkpi.llm import bits, bpe, chat, components, embed_join, mixing, ngram_join, quality, rules, samples, token_files, toxicity, warc
from fleetkpi.llm.words import Words, shingle_sets, slices, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, copies string"
LONG = "word " * 3000 + "x" * 50_000 + " é  tail"
ODD = [
    (1, "a b c d e f g h i j", "en", "s", 1, "x", "y"),
    (2, "a b c d e f g h i j", "en", "s", 1, None, None),
    (2, "a b c d e f g h i j", "en", "s", 1, None, None),
    (3, None, None, None, None, None, None),
    (4, "", "en", None, None, None, None),
    (5, " \n\t ", "en", "s", None, None, None),
    (None, "a b c d e f g h i j", "de", "t", None, None, None),
    (6, LONG, None, "t", None, None, None),
    (7, "one", "en", "s", None, None, None),
    (8, "ONE", "en", "s", None, None, None),
    (9, "</s>[INST] <|endoftext|> \\ Σς İ ½", "en", "s", None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- shared parts


def shingles(text):
    lower = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({b" ".join(words)} if words else set())


def test_words_do_not_join_across_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"text": t} for t in ("ab", "c", None, "", "d  e\n", "é")])
    words = Words(*texts(batch.column("text")), lower=True)
    assert words.counts.tolist() == [1, 1, 0, 0, 2, 1]
    assert sum(p.num_rows for p in slices(batch, "text", 2)) == 6
    values, edges = shingle_sets(words)
    assert np.diff(edges).tolist() == [1, 1, 0, 0, 1, 1] and len(set(values.tolist())) == 4


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    edges += [tuple(map(int, rng.integers(1000, 1100, 2))) for _ in range(90)]
    rng.shuffle(edges)
    rows = [(int(a), int(b)) for a, b in edges]
    parent = {x: x for e in rows for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.components(table(spark, rows, "a bigint, b bigint").repartition(5)).collect()}
    tied = {x for a, b in rows if a != b for x in (a, b)}
    assert got == {x: root(x) for x in tied}
    assert components.components(table(spark, [], "a bigint, b bigint")).count() == 0


def test_id_filter_never_misses(spark):
    ids = np.arange(0, 5000, 7)
    wanted = bits.id_filter(spark.createDataFrame([(int(i),) for i in ids], "id bigint")).load()
    assert wanted(ids).all() and wanted(np.arange(10**6, 10**6 + 1000)).mean() < 0.05


# ---------------------------------------------------------------- 1 chat


def test_chat_round_trip_and_media(spark):
    parts = [
        [("text", "look <|image|> ", None, None, None, None, None), ("image", None, "a.png", 56, 57, None, None)],
        [("audio", None, "b.wav", None, None, 2.01, None), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None)],
        None,
    ]
    rows = [(1, 0, "user", parts[0]), (1, 1, "assistant", parts[1]), (1, 1, "assistant", parts[1]), (2, None, None, parts[2])]
    schema = f"conv_id bigint, turn bigint, role string, parts {chat.PARTS.replace('struct<', 'struct<')}"
    out = {r.conv_id: r for r in chat.format_chat(table(spark, rows, schema)).collect()}
    assert out[1].formatted.startswith("<|im_start|>user<|im_sep|>look <\\|image|> <|image|><|im_end|>\n")
    assert [(a.type, a.ref, a.tokens) for a in out[1].attachments][:3] == [("image", "a.png", 6), ("audio", "b.wav", 51), ("document", "c.pdf", 1536)]
    assert out[1].media_tokens == 6 + 2 * (51 + 1536) and out[2].formatted == "<|im_start|><|im_sep|><|im_end|>\n"
    assert chat.format_chat(table(spark, [], schema)).count() == 0


def test_chat_escapes_are_reversible(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\<|im_end|>", "<\\|im_end|>", "<<SYS>>\n\\\\[INST]", "", None, "$1 \\$1", "<|im_start|>x<|im_sep|>"]
    rows = [(i // 3, i, "assistant" if i % 2 else "us<|im_sep|>er", t) for i, t in enumerate(said)]
    df = table(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text"))))
    for row in chat.read_chat(formatted).collect():
        own = [(r, t or "") for c, _, r, t in rows if c == row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == own
        assert row.loss_text == "".join(t for r, t in own if r == "assistant")


# ---------------------------------------------------------------- 2 and 8 tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    tok.no_padding()
    tok.no_truncation()
    return tok


def test_words_as_the_library_has_them(library):
    own, rng = bpe.WordTokenizer(bpe.default_path()), np.random.default_rng(5)
    letters = list("abZ Éé Σσς İı ßẞ'’stlld12٣½²_-.,!<|>endoftext́ ​\x1c\x85 漢字\U0001f600ǅK\n\t#ͅΑ")
    for i in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(0, 25)))) + "<|endoftext|>" * (i % 5 == 0) + "'S"
        ids = [x for word in own.words(text) for x in own.ids(word)]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def expected_tokens(library, rows):
    return {(d, t): library.encode(t or "", add_special_tokens=False).ids for d, t in rows}


def test_bpe_round_trip(spark, odd, empty, documents, library):
    for docs in (odd.select("doc_id", "text", F.lit(1).alias("ids"), F.lit("x").alias("decoded")), documents):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs.repartition(3))).collect())
        ids = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
        assert got == Counter((d, tuple(x), library.decode(x, skip_special_tokens=False)) for d, x in ids)
        assert got == Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, decoded=True).collect())
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_serialized_ids_of_words(library, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_STRETCHES", 40)
    known, rng = token_files._Known(bpe.default_path(), 2), np.random.default_rng(6)
    letters = list("abJǰ Éé Σς İß'’stld12½-.,!<|>\u0301\u030c\u0307 \x1c\x85 漢\U0001f600\n")
    texts_ = ["".join(rng.choice(letters, int(rng.integers(0, 30)))) + "<|endoftext|>" * (i % 7 == 0) for i in range(1500)]
    for text in texts_:
        assert np.frombuffer(known.ids(text, b"\x01\x00"), "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_numbers_pack_small_and_large():
    for top in (3, 224, 70_000, 2_000_000, 3_000_000):
        numbers = np.random.default_rng(top).integers(0, top, 5000).astype(np.uint32)
        numbers[0] = top - 1
        packed = [memoryview(x) for x in bpe._unpack(bpe._pack(*bpe._narrow(numbers)))]
        assert bpe._from_narrow(*packed).tolist() == numbers.tolist()


def test_each_text_is_cut_into_words_once(documents):
    encoded = bpe.encode(documents)
    assert encoded.count() == documents.count()
    rows = encoded.filter(F.size("ids") >= 0)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("MapInArrow") == 1


def test_dictionary_samples_reach_the_end_of_a_document():
    ids = np.arange(100_000, dtype="<u2").tobytes()
    got = np.frombuffer(token_files._sampled(ids, 2), "<u2")
    assert len(got) == token_files.SLICES * token_files.SLICE_IDS and got[0] == 0 and got[-1] == np.frombuffer(ids, "<u2")[-1]
    assert token_files._sampled(ids[:100], 2) == ids[:100]


def test_one_document_is_read_by_its_frame(spark, documents, monkeypatch):
    from fleetkpi.llm import files

    written = token_files.write_tokens(documents)
    row = written.manifest.first()
    read, whole = [], files.opened(written.folder, row.file)

    class Counted:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            whole.close()

        def size(self):
            return whole.size()

        def read_at(self, n, at):
            read.append(n)
            return whole.read_at(n, at)

    monkeypatch.setattr(files, "opened", lambda folder, name: Counted())
    first = documents.agg(F.min("doc_id")).first()[0]
    size = whole.size()
    assert token_files.read_document(written.folder, row.file, first) and sum(read) < size / 3


def test_few_documents_have_no_dictionary(spark, library):
    docs = table(spark, [(1, "one two"), (2, "two")], "doc_id bigint, text string")
    written = token_files.write_tokens(docs)
    assert written.dictionary is None
    got = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, written, with_ids=True).collect()}
    assert got == {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in ((1, "one two"), (2, "two"))}


def test_token_files(spark, odd, empty, documents, library, tmp_path):
    for docs in (odd, documents):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
        written = token_files.write_tokens(docs)
        got = sorted(token_files.read_tokens(spark, written, with_ids=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [d for d, _ in rows]
        start = 0
        for r in got:
            assert r.start == start and r.n_tokens == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            start += r.n_tokens
        want = Counter((d, *library.encode(t, add_special_tokens=False).ids, 1) for d, t in rows)
        assert Counter((r.doc_id, *r.ids) for r in got) == want
    some = written.manifest.first().file
    doc = next(r for r in got if r.doc_id == rows[0][0])
    assert token_files.read_document(written.folder, some, rows[0][0]) == list(doc.ids)
    assert written.dictionary
    assert token_files.read_tokens(spark, token_files.write_tokens(empty)).count() == 0


# ---------------------------------------------------------------- 3 n-gram join


def brute_components(sets):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in sets}


def test_jaccard_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = list(rng.choice(vocabulary, 60))
    rows = []
    for _ in range(50):
        base = list(rng.choice(vocabulary, int(rng.integers(1, 160))))
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(int(rng.integers(1, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(["a"] * n)) for i, n in enumerate((1, 2, 3, 4, 5, 6, 4))]
    rows += [(1000, None), (1001, "")]
    df = table(spark, rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, buckets=3).collect()}
    sets = {d: shingles(t) for d, t in rows}
    want = brute_components(sets)
    assert got == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < len(rows) - 50


def test_signatures_find_small_sets(spark):
    # sets so small that few parts of the domain hold anything
    rows, bands = [], ngram_join.Bands(80)
    for i in range(400):
        base = [f"v{i}_{j}" for j in range(9 + i % 5)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, "more"]))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table(spark, rows, "doc_id bigint, text string")).collect()}
    want = brute_components_of_pairs(rows)
    assert got == want and (bands.parts > bands.k).all()


def brute_components_of_pairs(rows):
    out = {}
    for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True):
        s, t = shingles(x), shingles(y)
        linked = 100 * len(s & t) >= 80 * len(s | t)
        out[a], out[b] = a, a if linked else b
    return out


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**62, int(rng.integers(1, 300))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**62, 9).astype(np.uint64)]))
        one, two = ngram_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        size = min(len(one), len(two)) // 8
        apart = np.bitwise_count(ngram_join._folded(one, size) ^ ngram_join._folded(two, size)).sum()
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def _list_rows(group, refuted):
    """A list of near copies that nothing connects yet; sketches of 256 cells that differ in two."""
    sketches = []
    for i in range(group):
        cells = np.zeros(256, np.uint8)
        cells[i % 256] = 1
        sketches.append(np.packbits(cells, bitorder="little").tobytes())
    ids = np.arange(group)
    none = [[j for j in range(i + 1, group)] if refuted else None for i in range(group)]
    return pd.DataFrame({"list_key": 1, "member": ids, "component": ids, "n_shingles": 100, "sketch": sketches, "refuted": none})


def test_jaccard_candidates_follow_the_members_of_a_list():
    for group in (100, 400):
        found = ngram_join._cross_pairs(80, 4)(_list_rows(group, refuted=False))
        assert group - 1 <= len(found) <= 4 * group and (found["a"] < found["b"]).all()
        assert not len(ngram_join._cross_pairs(80, 4)(_list_rows(group, refuted=True)))


def test_jaccard_lists_are_compared_together_and_settled_ones_are_left_alone():
    """Pairs stay within their list however batches cut it; only a list with more pairs than it may hand in goes on."""
    lists = [_list_rows(group, refuted=False) for group in (3, 100, 4, 70)]
    rows = pd.concat([x.assign(list_key=7 * i - 9, member=x["member"] + 1000 * i, component=x["component"] + 1000 * i) for i, x in enumerate(lists)])
    whole = ngram_join._cross_pairs(80, 4)(rows)
    assert (whole["a"] // 1000 == whole["b"] // 1000).all() and set(whole["list_key"].dropna()) == {-2, 12}
    assert (whole["a"] < 1000).sum() == 3 and (whole["a"] // 1000 == 2).sum() == 6
    pairs = sorted(zip(whole["a"], whole["b"], strict=True))
    for many in (1, 7, 101, 1000):
        parts = pd.concat(ngram_join._listed(80, 4)(rows.iloc[at : at + many] for at in range(0, len(rows), many)))
        assert sorted(zip(parts["a"], parts["b"], strict=True)) == pairs


def test_jaccard_components_of_a_list_hand_in_few_pairs():
    """Two groups that are connected within need one link; the list goes on until all pairs are refuted."""
    rows = _list_rows(60, refuted=False)
    rows["component"] = rows["member"] % 2
    found = ngram_join._cross_pairs(80, 4)(rows)
    assert len(found) == 4 and (found["a"] % 2 != found["b"] % 2).all() and set(found["list_key"]) == {1}
    seen, most = set(), 4
    while len(found):
        assert not seen & (new := set(zip(found["a"].tolist(), found["b"].tolist(), strict=True)))
        seen |= new
        rows["refuted"] = [[b for a, b in seen if a == i] or None for i in range(60)]
        most *= 4
        found = ngram_join._cross_pairs(80, most)(rows)
    assert seen == {(a, b) for a in range(60) for b in range(a + 1, 60) if (a - b) % 2}


def test_jaccard_rounds_lose_no_link(spark, monkeypatch):
    """Members that share passages, hand in one candidate at a time and are mostly refuted."""
    monkeypatch.setattr(ngram_join, "CROSS", 1)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 1, 2, 3])):
            words[at] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    component = brute_components({i: shingles(t) for i, t in rows})
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table(spark, rows, "doc_id bigint, text string"), buckets=2).collect()}
    assert got == component and 1 < len(set(component.values())) < 40


def test_jaccard_lists_with_few_open_pairs_hand_in_all_at_once():
    """Two groups of 30, of which ten members each are alike: 100 pairs are fewer than four for each of 60 members."""
    rows = _list_rows(60, refuted=False)
    rows["component"] = rows["member"] % 2
    far = np.packbits(np.arange(256) < 128, bitorder="little").tobytes()
    rows["sketch"] = [s if i < 20 else np.bitwise_xor(np.frombuffer(s, np.uint8), np.frombuffer(far, np.uint8) * (i % 2)).tobytes() for i, s in enumerate(rows["sketch"])]
    rows["refuted"] = [[j for j in range(20, 60)] for _ in range(60)]
    found = ngram_join._cross_pairs(80, 4)(rows)
    want = {(a, b) for a in range(20) for b in range(a + 1, 20) if (a - b) % 2}
    assert set(zip(found["a"].tolist(), found["b"].tolist(), strict=True)) == want and len(found) == 100
    assert found["list_key"].isna().all()


def test_jaccard_copies_in_a_list_hand_in_no_more_pairs(spark, monkeypatch):
    """Copies that different tasks have packed are members of a list each; the smallest stands for all."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 1, 2, 3])):
            words[at] = f"x{rng.randrange(4)}"
        rows.append((10 * i, " ".join(words)))
    handed, write = [], ngram_join.materialise

    def written(df):
        out = write(df)
        if out.columns == ["a", "b", "list_key"]:
            handed.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", written)
    numbers = []
    for copies in (1, 5):
        handed.clear()
        dealt = spark.sparkContext.parallelize([(d + c, t) for c in range(copies) for d, t in rows], copies)
        docs = spark.createDataFrame(dealt, "doc_id bigint, text string")
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, buckets=2).collect()}
        one = brute_components({d: shingles(t) for d, t in rows})
        assert got == {d + c: x for d, x in one.items() for c in range(copies)}
        numbers.append(list(handed))
    assert numbers[0] == numbers[1] and sum(numbers[0]) > 0


def test_jaccard_empty_texts_of_shared_ids_link_nothing(spark):
    docs = table(spark, [(1, ""), (2, None), (1, "a b c d e"), (2, "f g h i j")], "doc_id bigint, text string")
    pairs = table(spark, [(1, 2), (1, 2)], "a bigint, b bigint")
    assert [r.linked for r in ngram_join._by_sets(docs, pairs, 80).collect()] == [False] * 4


def test_jaccard_odd_input(odd, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd).collect())
    assert got[(None, 6, None)] == 1 and got[(2, 6, 1)] == 2 and got[(1, 6, 1)] == 1
    assert got[(3, 0, 3)] == got[(4, 0, 4)] == got[(5, 0, 5)] == 1 and got[(8, 1, 7)] == 1
    assert sum(got.values()) == len(ODD)
    assert ngram_join.jaccard_components(empty).count() == 0


# ---------------------------------------------------------------- 4 and 5 classifiers


def test_ordinal_grades_come_out_in_order():
    rng = np.random.default_rng(0)
    words = ["good", "fine", "text", "here"]
    noisy = lambda share: " ".join("##!" if rng.random() < share else str(rng.choice(words)) for _ in range(60))
    shares = [0.9, 0.5, 0.1, 0.0]
    model = quality.fit([noisy(s) for s in shares * 60], list(range(4)) * 60)
    assert (np.diff(model.thresholds) > 0).all()
    import pyarrow as pa

    tails = model.tails(*texts(pa.array([noisy(s) for s in shares * 20])))
    expected = tails.sum(axis=1).reshape(20, 4).mean(axis=0)
    assert (np.diff(expected) > 0.2).all() and (np.diff(tails, axis=1) <= 0).all()
    assert quality.fit([], []).tails(*texts(pa.array(["x", ""]))).tolist() == [[0.5], [0.5]]


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, quality.graded(labels.where(~samples.held_out())))
    rows = quality.score(docs, model).join(labels.where(samples.held_out()), "doc_id").select("quality", "tail").collect()
    right = [(r.tail >= 0.5) == (r.quality == 1) for r in rows]
    assert np.mean(right) > 0.9 and np.mean([r.tail >= 0.5 for r in rows if r.quality == 1]) > 0.97


def test_quality_learns_from_whole_texts(spark):
    import pyarrow as pa

    clean = "good fine text here " * 1100
    rows = [(i, clean + f"{i} " + "##! $$% " * (3000 * (i % 2)), 1 - i % 2) for i in range(40)]
    docs = table(spark, [r[:2] for r in rows], "doc_id bigint, text string")
    model = quality.train(docs, table(spark, [(r[0], r[2]) for r in rows], "doc_id bigint, grade int"))
    junk, good = model.tails(*texts(pa.array(["##! $$% " * 50, clean])))[:, 0]
    assert junk < 0.1 and good > 0.7
    with pytest.raises(ValueError):
        quality.train(docs, table(spark, [(i, i) for i in range(65)], "doc_id bigint, grade int"))


def test_quality_odd_input(odd, empty):
    model = quality.fit(["a b", "# #"], [1, 0])
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.tail <= 1 for r in rows)
    assert quality.score(empty, model).count() == 0


def test_toxicity_learns_words_in_windows():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    common = [f"word{i}" for i in range(300)]

    def text(bad):
        words = list(rng.choice(common, int(rng.integers(20, 200))))
        for _ in range(3 * bad):
            words.insert(int(rng.integers(len(words))), str(rng.choice(["nasty", "vile", "foul"])))
        return " ".join(words)

    label = [int(x) for x in rng.random(300) < 0.3]
    model = toxicity.fit([text(x) for x in label], label)
    truth = np.array([int(x) for x in rng.random(200) < 0.3])
    scores = model.scores(*texts(pa.array([text(x) for x in truth])))
    assert ((scores >= 0.5) == truth).mean() > 0.95
    # a word in the last window of a long text counts as much
    long = " ".join(rng.choice(common, 3000))
    low, high = model.scores(*texts(pa.array([long, long + " nasty vile foul"])))
    assert low < 0.5 < high


def test_toxicity_learns_from_the_end_of_long_texts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "STEPS", 20)
    rng = np.random.default_rng(8)
    common = [f"word{i}" for i in range(300)]
    text = lambda n, bad: " ".join([*rng.choice(common, n), *["nasty vile foul"] * (20 * bad)])
    rows = [(i, text(1600, i % 2), i % 2) for i in range(50)]
    docs = table(spark, [r[:2] for r in rows], "doc_id bigint, text string")
    labels = table(spark, [(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    truth = np.arange(40) % 2
    unseen = texts(pa.array([text(1600, x) for x in truth]))
    models = [toxicity.train(docs, labels, at_driver=n) for n in (0, 1 << 30)]
    for model in models:
        assert ((model.scores(*unseen) >= 0.5) == truth).all()
    # windows chosen on executors are those chosen at the driver
    assert (models[0].vocabulary == models[1].vocabulary).all()
    assert np.allclose(models[0].scores(*unseen), models[1].scores(*unseen), atol=0.05)


def test_toxicity_gradients():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    text = toxicity.Text.read(*texts(pa.array(["a b c d e f", "c d x y"])))
    vocabulary = np.sort(text.hashes[:4])
    p = {k: v.astype(np.float64) for k, v in toxicity._start(rng, vocabulary, np.zeros(4, np.float32)).items()}
    _, first, size = text.windows()
    ids, there = toxicity._places(text, first, size)
    label, cost = np.array([1, 0]), np.array([0.5, 0.5])

    def loss():
        logit = toxicity._forward(p, toxicity._tables(p, toxicity._word_inputs(p, vocabulary, text)), ids, there)[0]
        return float((cost * (np.logaddexp(0, logit) - label * logit)).sum())

    g = toxicity._gradients(p, vocabulary, text, toxicity._word_inputs(p, vocabulary, text), ids, there, label, cost)
    for name in ("uf", "xb", "cf", "att", "att_v", "out", "word"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        kept, step = p[name][at], 1e-2
        p[name][at] = kept + step
        up = loss()
        p[name][at] = kept - step
        down = loss()
        p[name][at] = kept
        assert math.isclose((up - down) / (2 * step), g[name][at], rel_tol=0.05, abs_tol=1e-4), name


def test_toxicity_odd_input(spark, odd, empty):
    none = toxicity.fit([], [])
    rows = toxicity.score(odd, none).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, none).count() == 0
    labels = table(spark, [(1, 1), (1, None), (None, 1), (99, 0), (7, 0)], "doc_id bigint, toxic int")
    assert samples.labelled_texts(odd, labels, "toxic", 10)[1] in ([1, 0], [0, 1])
    assert samples.labelled_texts(odd, labels.limit(0), "toxic", 10) == ([], [])


# ---------------------------------------------------------------- 6 rules


def brute_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rule_counts(odd, documents, empty):
    for docs in (odd, documents):
        want = Counter((r.doc_id, *brute_counts(r.text)) for r in docs.collect())
        rows = rules.judge(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert rules.judge(empty).count() == 0


def test_quartiles_of_merged_sketches(spark):
    rng = np.random.default_rng(1)
    cells = [("en", f"s{i % 3}", "symbols", int(x)) for i, x in enumerate(rng.integers(0, 40, 500))]
    sketch = table(spark, cells, "lang string, source string, rate string, cell int").groupBy("lang", "source", "rate", "cell").agg(F.count("*").alias("n"))
    row = rules.quartiles(sketch, "lang").first()
    values = sorted(c[3] for c in cells)
    assert (row.q1, row.q3, row.docs) == (values[124], values[374], 500)


def test_outlying_rates_go(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "s") for i in range(150)]
    rows.append((999, " ".join(f"#*{j}$%" for j in range(80)), "en", "s"))
    got = {r.doc_id: r.kept for r in rules.judge(table(spark, rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got.pop(999) and all(got.values())


def test_limits_follow_the_group(spark):
    # of 1,040 characters none is a symbol in prose; in code 30 to 69 are
    text = lambda i, n: " ".join("#" * min(6, max(0, n - 6 * j)) + "w" * max(0, 6 - max(0, n - 6 * j)) + f"{i:05d}{j:02d}" for j in range(80))
    rows = [(i, text(i, 0), "en", "prose") for i in range(1100)]
    rows += [(2000 + i, text(2000 + i, 30 + i % 40), "en", "code") for i in range(1100)]
    rows += [(9000, text(9000, 60), "en", "prose"), (9001, text(9001, 3), "en", "prose"), (9002, text(9002, 400), "en", "code")]
    got = {r.doc_id: r.kept for r in rules.judge(table(spark, rows, "doc_id bigint, text string, lang string, source string")).collect()}
    # 60 of 1,040 are far more than prose has, but not than code has; three may be chance
    assert not got.pop(9000) and not got.pop(9002) and all(got.values())


# ---------------------------------------------------------------- 7 mixing


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    goal, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[n] for n in full)
        open_weight = sum(weight[n] for n in names if n not in full)
        goal = {n: 3.0 * sizes[n] if n in full else rest * weight[n] / open_weight for n in names}
        more = {n for n in names if n not in full and goal[n] > 3 * sizes[n] * (1 + 1e-12)}
        if not more:
            return goal
        full |= more


def test_targets(spark):
    rng = np.random.default_rng(9)
    for _ in range(4):
        sizes = {f"s{i}": int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for i in range(9)} | {None: 40, "é": 3, "Z": 5}
        rows = table(spark, list(sizes.items()), "source string, size bigint")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        for name, goal in brute_targets(sizes).items():
            assert math.isclose(got[name], goal, rel_tol=1e-9, abs_tol=1e-9)


def test_mix_meets_targets_and_reruns_agree(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert Counter((r.doc_id, r.taken) for r in rows) == again and len(rows) == docs.count()
    taken, size, goal = Counter(), Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r.size
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.rate <= 3
    for s in goal:
        assert abs(taken[s] - goal[s]) < 0.02 * goal[s]
    # rates solve the dual: their words are the target, and they are exponential in the size
    for s in goal:
        own = [r for r in rows if r.source == s]
        assert math.isclose(sum(r.rate * r.size for r in own), goal[s], rel_tol=1e-6)
        free = [math.log(r.rate) / r.size for r in own if r.size and r.rate < 3]
        assert max(free) - min(free) < 1e-9
    out = mixing.mix(odd).collect()
    assert len(out) == len(ODD) and all(r.taken <= 3 * r.size for r in out)
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- 9 embeddings


@pytest.mark.parametrize("dim", [3, 20, 64, 300])
def test_vectors_are_turned_alike_in_batches_of_any_size(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(501, dim)) * np.exp(rng.normal(size=(501, 1)) * 3)
    plan = embed_join.Plan(dim, x[:301], 501, 0.95, 16)
    whole = plan.turn(x)
    assert np.abs(whole - (x / np.linalg.norm(x, axis=1)[:, None]) @ (plan.rotation / plan.unit)).max() < 1e-5
    homes = [home for _, home, _ in embed_join._placed(plan, whole)]
    for size in range(1, 8):
        parts = [plan.turn(x[a : a + size]) for a in range(0, len(x), size)]
        assert (np.concatenate(parts) == whole).all()
        for block, home in enumerate(homes):
            assert (np.concatenate([list(embed_join._placed(plan, p))[block][1] for p in parts]) == home).all()


def test_links_are_counted_once_on_median_cuts(spark):
    """An odd number of vectors lies on every cut of the trees, and batches have five rows."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(333, 16))
    rows = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), base + 0.05 * rng.normal(size=base.shape)])
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {r.vec_id: r.n_links for r in embed_join.link_components(df, leaf=32).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        base = rng.normal(size=20)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((base + rng.normal(size=20) * float(rng.choice([0, 0.1, 0.2, 0.3]))).tolist())
    rows += [None, [0.0] * 20, [], [1.0, None], [float("nan")] * 20, [float("inf")] * 20, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v, 1) for i, v in enumerate(rows)] + [(None, rows[0], 1)]
    df = table(spark, data, "vec_id bigint, embedding array<double>, links int").repartition(4)
    for leaf, tile, visitors, batch in ((20, 7, 11, 3), (10**6, 10**6, 10**6, 10_000), (30, 10**6, 5, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.vec_id: r for r in embed_join.link_components(df, leaf=leaf, tile=tile, visitors=visitors).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(data) and got[None].n_links == 0 and not got[None].kept and got[None].component_id is None
        n = len(rows)
        fine = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for v in rows]
        near = defaultdict(set)
        for i in range(n):
            for j in range(i + 1, n):
                if fine[i] and fine[j] and len(rows[i]) == len(rows[j]):
                    a, b = np.array(rows[i]), np.array(rows[j])
                    if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.95:
                        near[i].add(j)
                        near[j].add(i)
        label = list(range(n))
        while True:
            new = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
            if new == label:
                break
            label = new
        for i in range(n):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), label[i], label[i] == i)
    assert embed_join.link_components(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 10 archives


def test_warc_round_trip(spark):
    pages = [(i, f"http://x/{i} y" if i % 4 else None, [None, "", "<p>é</p>", f"p{i}", "z" * 200_000][i % 5]) for i in range(40)]
    pages += [(None, "u", "<p>é</p>"), (3, "again", "p3"), (50, "a\nb\x00", "\r\n\r\n")]
    df = table(spark, pages, "page_id bigint, url string, html string").repartition(3)
    rows = warc.pages_as_warc(df).collect()
    assert len(rows) == len(pages)
    largest = defaultdict(int)
    for page, _, html in pages:
        largest[html or ""] = max(largest[html or ""], page or 0)
    by_digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): (len(h.encode()), top) for h, top in largest.items()}
    for r in rows:
        size, top = by_digest[r.payload_digest]
        assert r.payload_bytes == size
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
    assert warc.pages_as_warc(df.limit(0)).count() == 0
    few = warc.archive_pages(df)
    least = warc.read_warc(*warc.convert(few[0], warc.index(*few), min_bytes=5)).collect()
    assert all(r.record_type == "response" for r in least if r.payload_bytes < 5)


def test_arc_headers():
    for version in (1, 2):
        start = warc.arc_start(version, "n", "20000101000000")
        assert warc.arc_version(start) == version
        record = warc.arc_record(version, "http://a b", "1.2.3.4", "20000101000000", "text/html", 200, b"x\ny", "n", 9)
        parsed = warc.parse_arc(record, version)
        assert parsed.body == b"x\ny" and parsed.fields["URL"] == "http://a%20b"
        with pytest.raises(ValueError):
            warc.parse_arc(record[:-3], version)
        with pytest.raises(ValueError):
            warc.parse_arc(record, 3 - version)


def test_texts_are_whole():
    assert unicodedata.normalize("NFC", LONG) and len(LONG) > 60_000
