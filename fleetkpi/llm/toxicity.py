"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is the sequence of its words (runs of letters and digits, lower case). A word enters by its own
embedding, where the training sample has it often enough, and by the mean embedding of its byte trigrams. Windows of `WINDOW` words, a
new one every `STEP` words, run through a forward and a backward gated recurrent layer; attention
pools the states of a window and a logistic unit scores it. A document has the score of its highest
window, put on the scale of probabilities by a logistic fit on the training documents.

Labels are those of whole documents. Training therefore learns from the window that now scores
highest in each document and, for documents without the label, from another one at random. One input
dimension of a word starts as the evidence of its document counts in the training sample, and the
vocabulary is the words with the strongest evidence. Whole sample texts are read in every epoch, on
the executors where they are many: only the chosen windows come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..storage import materialise
from .samples import held_out, labelled, ordered
from .words import BYTES, MARKS, Words, slices, texts

WINDOW, STEP = 48, 40
HIDDEN, WIDTH, ATTENTION = 8, 8, 4
#: Words with an embedding of their own at most; sample documents that must have them; buckets of trigrams.
VOCABULARY, LEAST_DOCS, CHAR_BUCKETS = 8192, 3, 1 << 12
#: The network is fitted on so many documents of each label at most. Samples up to so many bytes are
#: fitted at the driver, where an epoch costs no job.
SAMPLE, AT_DRIVER = 1500, 2 * BYTES
EPOCHS, STEPS, BATCH, RATE, SEED = 8, 400, 128, 0.02, 7
#: Windows that run through the layers together.
BLOCK = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Text:
    """Words of texts by their place in a table of distinct words."""

    hashes: np.ndarray  # of each distinct word
    chars: np.ndarray  # buckets of the trigrams of all distinct words
    chars_at: np.ndarray  # where those of each begin, and their end
    ids: np.ndarray  # distinct word at each place
    edges: np.ndarray  # places of each text
    words: Words | None = None

    @classmethod
    def read(cls, data: np.ndarray, offsets: np.ndarray) -> Text:
        words = Words(data, offsets, lower=True, between=MARKS)
        hashes = words.hashes()
        distinct, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        starts, lengths = words.starts[first], (words.ends - words.starts)[first]
        # one trigram for each byte: the one before, itself, the one after; outside the word zero
        n = int(lengths.sum())
        shift = np.cumsum(lengths) - lengths
        inside = np.arange(n) - np.repeat(shift, lengths)
        at = np.repeat(starts, lengths) + inside
        middle = words.data[at].astype(np.uint32)
        before = np.where(inside > 0, words.data[np.maximum(at - 1, 0)], 0).astype(np.uint32)
        last = inside == np.repeat(lengths, lengths) - 1
        after = np.where(last, 0, words.data[np.minimum(at + 1, max(len(words.data) - 1, 0))]).astype(np.uint32)
        gram = (before << np.uint32(16) | middle << np.uint32(8) | after) * np.uint32(2654435761)
        return cls(
            distinct,
            (gram >> np.uint32(32 - 12)).astype(np.int64),
            np.append(shift, n),
            ids,
            words.edges,
            words,
        )

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first place and number of words of every window."""
        counts = np.diff(self.edges)
        many = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STEP), 0) + 1, 0)
        doc = np.repeat(np.arange(len(counts)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        return doc, self.edges[doc] + nth * STEP, np.minimum(counts[doc] - nth * STEP, WINDOW)


Params = dict[str, np.ndarray]


def _start(rng: np.random.Generator, vocabulary: np.ndarray, evidence: np.ndarray) -> Params:
    h, x = HIDDEN, 2 * WIDTH
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    p = {
        # row 0 is for all words outside the vocabulary
        "word": normal(len(vocabulary) + 1, WIDTH, scale=0.1),
        "char": normal(CHAR_BUCKETS, WIDTH, scale=0.1),
        "att": normal(2 * h, ATTENTION, scale=0.3),
        "att_v": normal(ATTENTION, scale=0.3),
        "out": normal(2 * h, scale=0.3),
        "bias": np.zeros(1, np.float32),
    }
    for side in "fb":
        p["x" + side] = normal(x, 3 * h, scale=0.3)
        p["c" + side] = np.zeros(3 * h, np.float32)
        p["u" + side] = normal(h, 3 * h, scale=0.3)
    p["word"][0] = 0
    p["word"][1:, 0] = evidence
    return p


def _rows(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each word in the embedding of words; vocabulary holds sorted hashes."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _word_inputs(p: Params, vocabulary: np.ndarray, text: Text) -> np.ndarray:
    sizes = np.diff(text.chars_at)
    sums = np.zeros((len(sizes), WIDTH), np.float32)
    if len(sizes):
        sums = np.add.reduceat(p["char"][text.chars], text.chars_at[:-1], axis=0) / sizes[:, None]
    return np.concatenate([p["word"][_rows(vocabulary, text.hashes)], sums.astype(np.float32)], axis=1)


def _tables(p: Params, inputs: np.ndarray) -> dict[str, np.ndarray]:
    """Gate inputs of every distinct word; the last row stands for a place without a word."""
    return {s: np.vstack([inputs @ p["x" + s] + p["c" + s], np.zeros((1, 3 * HIDDEN), np.float32)]) for s in "fb"}


def _places(text: Text, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words [place, window] of windows, and where there is one."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    there = np.arange(WINDOW)[:, None] < size[None, :]
    empty = len(text.hashes)
    return np.where(there, text.ids[np.minimum(at, len(text.ids) - 1)], empty), there


def _layer(p: Params, side: str, gates: np.ndarray, there: np.ndarray, keep: bool):
    """States [place, window, unit] of one direction, and what the way back needs."""
    h, n, b = HIDDEN, *there.shape
    state = np.zeros((b, h), np.float32)
    states = np.empty((n, b, h), np.float32)
    kept = []
    u = p["u" + side]
    mask = there.astype(np.float32)[:, :, None]
    for t in range(n) if side == "f" else range(n - 1, -1, -1):
        x = gates[t]
        y = state @ u
        zr = x[:, : 2 * h] + y[:, : 2 * h]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
        after = new + z * (state - new)
        after *= mask[t]
        if keep:
            kept.append((t, state, z, r, new, y[:, 2 * h :]))
        states[t] = state = after
    return states, kept


def _forward(p: Params, tables: dict[str, np.ndarray], ids: np.ndarray, there: np.ndarray, keep: bool = False):
    sides, kept = [], {}
    for s in "fb":
        states, kept[s] = _layer(p, s, tables[s][ids], there, keep)
        sides.append(states)
    both = np.concatenate(sides, axis=2)
    hidden = np.tanh(both @ p["att"])
    weight = np.where(there, hidden @ p["att_v"], -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbi->bi", weight, both)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (both, hidden, weight, pooled, kept)


def _gradients(p: Params, vocabulary: np.ndarray, text: Text, inputs: np.ndarray, ids: np.ndarray, there: np.ndarray, label: np.ndarray, cost: np.ndarray) -> Params:
    tables = _tables(p, inputs)
    logit, (both, hidden, weight, pooled, kept) = _forward(p, tables, ids, there, True)
    h = HIDDEN
    g: Params = {}
    d_logit = ((_sigmoid(logit) - label) * cost).astype(np.float32)
    g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out"]
    d_weight = (both * d_pooled[None]).sum(axis=2)
    d_both = weight[:, :, None] * d_pooled[None]
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["att_v"] = np.einsum("tbk,tb->k", hidden, d_score)
    d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden**2)
    g["att"] = np.einsum("tbi,tbk->ik", both, d_hidden)
    d_both += d_hidden @ p["att"].T
    d_inputs = np.zeros_like(inputs)
    mask = there.astype(np.float32)[:, :, None]
    for i, s in enumerate("fb"):
        own = d_both[:, :, i * h : (i + 1) * h]
        d_gates = np.zeros((*there.shape, 3 * h), np.float32)
        d_state = np.zeros((there.shape[1], h), np.float32)
        g["u" + s] = np.zeros_like(p["u" + s])
        for t, state, z, r, new, y in reversed(kept[s]):
            d = (d_state + own[t]) * mask[t]
            d_new = d * (1 - z) * (1 - new**2)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * y * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_y = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g["u" + s] += state.T @ d_y
            d_state = d * z + d_y @ p["u" + s].T
        d_table = np.zeros_like(tables[s])
        np.add.at(d_table, ids.ravel(), d_gates.reshape(-1, 3 * h))
        d_table = d_table[:-1]
        g["x" + s], g["c" + s] = inputs.T @ d_table, d_table.sum(axis=0)
        d_inputs += d_table @ p["x" + s].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], _rows(vocabulary, text.hashes), d_inputs[:, :WIDTH])
    sizes = np.diff(text.chars_at)
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], text.chars, np.repeat(d_inputs[:, WIDTH:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
    return g


def _part(text: Text, ids: np.ndarray) -> tuple[Text, np.ndarray]:
    """The words of a few windows as a table of their own, and the windows in its places."""
    used, flat = np.unique(ids, return_inverse=True)
    real = used[used < len(text.hashes)]
    sizes = np.diff(text.chars_at)[real]
    at = np.repeat(text.chars_at[real] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    part = Text(text.hashes[real], text.chars[at], np.concatenate(([0], np.cumsum(sizes))), text.ids, text.edges)
    return part, flat.reshape(ids.shape)


def _window_logits(p: Params, vocabulary: np.ndarray, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, first, size = text.windows()
    tables = _tables(p, _word_inputs(p, vocabulary, text))
    out = np.empty(len(doc), np.float32)
    for a in range(0, len(doc), BLOCK):
        ids, there = _places(text, first[a : a + BLOCK], size[a : a + BLOCK])
        most = int(size[a : a + BLOCK].max())
        out[a : a + BLOCK] = _forward(p, tables, ids[:most], there[:most])[0]
    return doc, first, size, out


def _highest(doc: np.ndarray, logit: np.ndarray, docs: int, empty: float) -> np.ndarray:
    out = np.full(docs, -np.inf, np.float64)
    np.maximum.at(out, doc, logit)
    return np.where(np.isfinite(out), out, empty)


@dataclass
class Model:
    """Parameters of the network and the line that turns a document's logit into its score's."""

    params: Params
    vocabulary: np.ndarray
    slope: float
    shift: float

    def highs(self, text: Text) -> np.ndarray:
        doc, _, _, logit = _window_logits(self.params, self.vocabulary, text)
        return _highest(doc, logit, len(text.edges) - 1, float(self.params["bias"][0]))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.highs(Text.read(data, offsets)) + self.shift)


def _counts(text: Text, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of texts, and the texts of label 1 and 0 that have each."""
    doc = np.repeat(np.arange(len(label)), np.diff(text.edges))
    seen = np.unique(np.stack([doc, text.ids]), axis=1)
    n = len(text.hashes)
    up = np.bincount(seen[1][label[seen[0]] == 1], minlength=n)
    return text.hashes, up, np.bincount(seen[1][label[seen[0]] == 0], minlength=n)


def _evidence(hashes: np.ndarray, up: np.ndarray, down: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary, and how surely documents with a word have the label more often; -1 to 1. Words come sorted by hash."""
    rate = np.log((up + 0.5) / (label.sum() + 1)) - np.log((down + 0.5) / ((label == 0).sum() + 1))
    sure = rate / np.sqrt(1 / (up + 0.5) + 1 / (down + 0.5))
    enough = np.flatnonzero(up + down >= LEAST_DOCS)
    chosen = np.sort(enough[np.argsort(-np.abs(sure[enough]), kind="stable")[:VOCABULARY]])
    return hashes[chosen], np.tanh(sure[chosen] / 3).astype(np.float32)


def _picked(model: Model, text: Text, draw: np.ndarray, fresh: bool) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The texts that have windows, and for each its highest window and the one that `draw` (0 to 1) hits.

    A window is its words with spaces between. A fresh model has evidence only, which is added up.
    """
    if fresh:
        doc, first, size = text.windows()
        signs = np.maximum(model.params["word"][_rows(model.vocabulary, text.hashes), 0], 0)
        total = np.concatenate(([0], np.cumsum(signs[text.ids], dtype=np.float64)))
        logit = total[first + size] - total[first]
    else:
        doc, first, size, logit = _window_logits(model.params, model.vocabulary, text)
    many = np.bincount(doc, minlength=len(text.edges) - 1)
    begin = np.cumsum(many) - many
    order = np.lexsort((-logit, doc))
    has = np.flatnonzero(many)
    words, data = text.words, memoryview(text.words.data)

    def said(window: int) -> bytes:
        own = slice(first[window], first[window] + size[window])
        return b" ".join(data[a:b] for a, b in zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True))

    other = begin[has] + (draw[has] * many[has]).astype(np.int64)
    return has, [said(w) for w in order[begin[has]]], [said(w) for w in other]


class _Here:
    """Sample texts at hand, read once."""

    def __init__(self, samples: list[str], label: np.ndarray):
        self.label, self.parts = label, []
        batch = pa.RecordBatch.from_arrays([pa.array(samples, pa.large_string())], ["text"])
        at = 0
        for part in slices(batch, "text"):
            self.parts.append((slice(at, at + part.num_rows), Text.read(*texts(part.column("text")))))
            at += part.num_rows

    def evidence(self) -> tuple[np.ndarray, np.ndarray]:
        found = [_counts(text, self.label[own]) for own, text in self.parts]
        hashes, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        up, down = (np.bincount(at, np.concatenate([x[i] for x in found]), len(hashes)) for i in (1, 2))
        return _evidence(hashes, up, down, self.label)

    def picked(self, model: Model, draw: np.ndarray, fresh: bool) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        found = [_picked(model, text, draw[own], fresh) for own, text in self.parts]
        has = np.concatenate([x[0] + own.start for x, (own, _) in zip(found, self.parts, strict=True)])
        return has, [w for x in found for w in x[1]], [w for x in found for w in x[2]]

    def highs(self, model: Model) -> np.ndarray:
        return np.concatenate([model.highs(text) for _, text in self.parts])


class _Spread:
    """Sample texts (doc_id, label, text) in a table that the executors read."""

    def __init__(self, sample: DataFrame):
        rows = ordered(sample.select("doc_id", "label")).collect()
        ids, self.label = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.sample, self.order = sample, np.argsort(ids)
        self.ids = ids[self.order]

    def _each(self, found, fields: list[StructField]) -> list:
        """Rows of what `found` has for places in the sample and their text."""
        ids, order = self.ids, self.order

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    place = order[np.searchsorted(ids, part.column("doc_id").to_numpy())]
                    columns = found(place, Text.read(*texts(part.column("text"))))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [f.name for f in fields])

        return self.sample.mapInArrow(rows, StructType(fields))

    def evidence(self) -> tuple[np.ndarray, np.ndarray]:
        label = self.label

        def found(place: np.ndarray, text: Text):
            hashes, up, down = _counts(text, label[place])
            return hashes.view(np.int64), up.astype(np.int64), down.astype(np.int64)

        words = self._each(found, [StructField(x, LongType()) for x in ("hash", "up", "down")])
        words = words.groupBy("hash").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where(F.col("up") + F.col("down") >= LEAST_DOCS)
        up, down = F.col("up") + 0.5, F.col("down") + 0.5
        rate = F.log(up / float(label.sum() + 1)) - F.log(down / float((label == 0).sum() + 1))
        strongest = words.orderBy(F.abs(rate / F.sqrt(1 / up + 1 / down)).desc(), F.col("hash").bitwiseXOR(F.lit(-(2**63)))).limit(VOCABULARY)
        table = np.array([tuple(r) for r in strongest.collect()], np.int64).reshape(-1, 3)
        hashes = table[:, 0].astype(np.int64).view(np.uint64) if len(table) else np.zeros(0, np.uint64)
        table = table[np.argsort(hashes)]
        return _evidence(np.sort(hashes), table[:, 1], table[:, 2], label)

    def picked(self, model: Model, draw: np.ndarray, fresh: bool) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        label = self.label

        def found(place: np.ndarray, text: Text):
            has, top, other = _picked(model, text, draw[place], fresh)
            # of texts with the label only the highest window is learned
            other = [None if label[x] else w for x, w in zip(place[has], other, strict=True)]
            return place[has], pa.array(top, pa.binary()), pa.array(other, pa.binary())

        fields = [StructField("place", LongType()), StructField("top", BinaryType()), StructField("other", BinaryType())]
        rows = sorted(self._each(found, fields).collect(), key=lambda r: r["place"])
        return np.array([r["place"] for r in rows], np.int64), [bytes(r["top"]) for r in rows], [r["other"] for r in rows]

    def highs(self, model: Model) -> np.ndarray:
        fields = [StructField("place", LongType()), StructField("high", DoubleType())]
        out = np.empty(len(self.label))
        for r in self._each(lambda place, text: (place, model.highs(text)), fields).collect():
            out[r["place"]] = r["high"]
        return out


def _alike(label: np.ndarray) -> Model:
    share = (label.sum() + 0.5) / (len(label) + 1)
    none = np.zeros(0, np.uint64)
    return Model(_start(np.random.default_rng(SEED), none, none), none, 0.0, float(np.log(share / (1 - share))))


def fit(samples: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """A network fitted on whole texts with labels 0 and 1. With one label only, or none, all score alike."""
    label = np.array(labels, np.int64)
    return _alike(label) if not len(label) else _fitted(_Here(samples, label), epochs)


def _fitted(sample: _Here | _Spread, epochs: int) -> Model:
    label = sample.label
    if not len(label) or label.min() == label.max():
        return _alike(label)
    rng = np.random.default_rng(SEED)
    vocabulary, evidence = sample.evidence()
    p = _start(rng, vocabulary, evidence)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    weight = {v: len(label) / (2 * (label == v).sum()) for v in (0, 1)}
    step = 0
    epochs = max(epochs, -(-STEPS * BATCH // (len(label) + int((label == 0).sum()))))
    for epoch in range(epochs):
        has, top, other = sample.picked(Model(p, vocabulary, 1.0, 0.0), rng.random(len(label)), not epoch)
        if not len(has):
            return _alike(label)
        windows = top + [w for w, x in zip(other, label[has], strict=True) if x == 0]
        truth = np.concatenate([label[has], np.zeros(len(windows) - len(has), np.int64)])
        text = Text.read(*texts(pa.array(windows, pa.large_binary()).cast(pa.large_string())))
        first, size = text.edges[:-1], np.diff(text.edges)
        chosen = rng.permutation(len(windows))
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for a in range(0, len(chosen), BATCH):
            own = chosen[a : a + BATCH]
            ids, there = _places(text, first[own], size[own])
            part, places = _part(text, ids)
            cost = np.where(truth[own] == 1, weight[1], weight[0] / 2) / len(own)
            g = _gradients(p, vocabulary, part, _word_inputs(p, vocabulary, part), places, there, truth[own], cost)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v / max(1.0, norm) + 1e-6 * p[k]
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * v
                m[1] = 0.99 * m[1] + 0.01 * v * v
                p[k] = (p[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    slope, shift = _line(sample.highs(Model(p, vocabulary, 1.0, 0.0)), label)
    return Model(p, vocabulary, slope, shift)


def _line(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value, by Newton steps; the targets are drawn in a little."""
    up, down = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    centre, spread = x.mean(), x.std() + 1e-6
    v = (x - centre) / spread
    a = np.array([1.0, 0.0])
    design = np.stack([v, np.ones_like(v)], 1)
    for _ in range(50):
        q = _sigmoid(design @ a)
        hess = design.T @ (design * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, design.T @ (target - q) - 1e-3 * a)
        a = a + move / max(1.0, np.abs(move).max())
    slope = max(a[0], 1e-3) / spread
    return float(slope), float(a[1] - slope * centre)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, at_driver: int = AT_DRIVER) -> Model:
    """A network from the whole labelled documents that are not held out, `most` of each label at most."""
    sample = labelled(docs, labels.where(~held_out()), "toxic", most)
    if sample is None:
        return fit([], [])
    sample = materialise(sample.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id"))
    if (sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > at_driver:
        return _fitted(_Spread(sample), EPOCHS)
    rows = ordered(sample).collect()
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) with `score` and `predicted`.

    Every word of every text is in a window that is scored. A null text counts as empty; an empty
    text, or one without letters and digits, has the score of a window without evidence. Rows are
    scored by their text alone; columns called score or predicted already are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*kept)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = model.scores(*texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, "score"])

    scored = docs.mapInArrow(rows, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
