"""Quality: ordinal cumulative-link regression on graded ratings.

Grades are ordered numbers 0 to K - 1. A document is its byte trigrams, hashed into one table of
weights that all grades share (a word that repeats the last one has a mark there too); its value is the mean weight of its trigrams. The chance of a grade
above k is the logistic function of that value less the k-th of K - 1 ascending thresholds. From
these chances come the expected grade and the tail probability that selects documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .samples import labelled, ordered
from .words import Words, slices, texts

LOG_BUCKETS = 16
REPEATED = (1 << LOG_BUCKETS) - 1
#: The weights are fitted on so many documents of each grade at most.
SAMPLE = 1500
STEPS, RATE, RIDGE = 200, 0.5, 1e-4
#: Documents whose tail probability is below this are rejected.
LEAST = 0.5


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each byte of texts, none reaching into the text before."""
    d = data.astype(np.uint32)
    code = d.copy()
    code[1:] |= d[:-1] << np.uint32(8)
    code[2:] |= d[:-2] << np.uint32(16)
    lengths = np.diff(offsets)
    first = offsets[:-1][lengths > 0]
    code[first] = d[first]
    second = offsets[:-1][lengths > 1] + 1
    code[second] &= np.uint32(0xFFFF)
    code *= np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    code >>= np.uint32(32 - LOG_BUCKETS)
    # a word that repeats the one before it starts with a mark of its own
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.edges[:-1][words.counts > 0]] = False
    code[words.starts[again]] = REPEATED
    return code, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def values(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, lengths = _trigrams(data, offsets)
        out = np.zeros(len(lengths))
        full = np.flatnonzero(lengths)
        if len(full):
            out[full] = np.add.reduceat(self.weights[codes].astype(np.float64), offsets[:-1][full]) / lengths[full]
        return out

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chance of each grade above 0, 1, ... for each text."""
        return _sigmoid(self.values(data, offsets)[:, None] - self.thresholds[None, :])


def _shares(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the trigrams of each whole text, and the share of each bucket."""
    codes, lengths = _trigrams(data, offsets)
    found = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        count = np.bincount(codes[a:b], minlength=1 << LOG_BUCKETS)
        own = np.flatnonzero(count)
        found.append((own.astype(np.uint16), (count[own] / max(1, b - a)).astype(np.float32)))
    return found


def fit(samples: list[str], grades: list[int]) -> Model:
    """Weights and thresholds from whole texts with grades. Without texts all chances are a half; a grade
    that nobody has gets a threshold next to its neighbour's."""
    batch = pa.RecordBatch.from_arrays([pa.array(samples, pa.large_string())], ["text"])
    return _fitted([x for part in slices(batch, "text") for x in _shares(*texts(part.column("text")))], grades)


def _fitted(shares: list[tuple[np.ndarray, np.ndarray]], grades: list[int]) -> Model:
    top = max([1, *grades])
    none = Model(np.zeros(1 << LOG_BUCKETS, np.float32), np.zeros(top))
    used = [i for i, (own, _) in enumerate(shares) if len(own)]
    if not used:
        return none
    grade = np.array([grades[i] for i in used], np.int64)
    row = np.repeat(np.arange(len(used), dtype=np.int32), [len(shares[i][0]) for i in used])
    code = np.concatenate([shares[i][0] for i in used])
    share = np.concatenate([shares[i][1] for i in used])
    starts = np.searchsorted(row, np.arange(len(grade)))
    n = len(grade)
    # each grade weighs the same in all
    cost = np.array([1 / max(1, (grade == g).sum()) for g in range(top + 1)])[grade]
    cost /= cost.sum()
    # thresholds are a first one and logarithms of the steps to the next ones
    w, first, gaps = np.zeros(1 << LOG_BUCKETS), 0.0, np.zeros(max(top - 1, 0))
    square = [np.zeros_like(w), np.zeros(1 + len(gaps))]
    mean = [np.zeros_like(w), np.zeros(1 + len(gaps))]
    for step in range(1, STEPS + 1):
        theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        value = np.add.reduceat(share * w[code], starts)
        tail = _sigmoid(value[:, None] - theta[None, :])
        # chance of each grade as the difference of neighbouring tails
        up = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        chance = np.maximum(up[np.arange(n), grade] - up[np.arange(n), grade + 1], 1e-9)
        slope = up * (1 - up)
        d_up = np.zeros_like(up)
        d_up[np.arange(n), grade] -= cost / chance
        d_up[np.arange(n), grade + 1] += cost / chance
        d_link = (d_up * slope)[:, 1:-1]
        d_value, d_theta = d_link.sum(axis=1), -d_link.sum(axis=0)
        g_w = np.bincount(code, share * d_value[row], minlength=len(w)) + RIDGE * w / 1000
        g_t = np.concatenate(([d_theta.sum()], [d_theta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))]))
        rate = RATE if step < STEPS * 3 // 4 else RATE / 5
        moves = []
        for i, g in enumerate((g_w, g_t)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            moves.append(rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8))
        w -= moves[0]
        first -= moves[1][0] / 10
        gaps = np.clip(gaps - moves[1][1:] / 10, -6, 3)
    return Model(w.astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def train(docs: DataFrame, ratings: DataFrame, grade: str = "grade", most: int = SAMPLE) -> Model:
    """A model from ratings (doc_id, grade) of documents, `most` of each grade at most.

    Whole texts are counted on the executors; of each its buckets come to the driver, 65,536 at most.
    """
    sample = labelled(docs, ratings, grade, most)
    if sample is None:
        return fit([], [])
    fields = [StructField("doc_id", LongType()), StructField("label", LongType()), StructField("codes", BinaryType()), StructField("shares", BinaryType())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _shares(*texts(part.column("text")))
                columns = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *columns], [f.name for f in fields])

    sample = sample.select("doc_id", F.col("label").cast("bigint").alias("label"), "text")
    counted = ordered(sample.mapInArrow(rows, StructType(fields))).collect()
    shares = [(np.frombuffer(r["codes"], np.uint16), np.frombuffer(r["shares"], np.float32)) for r in counted]
    return _fitted(shares, [r["label"] for r in counted])


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from marks: 0 where quality is missing, 1 for good text that is toxic, 2 for the rest."""
    good, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.select("doc_id", F.when(good == 0, 0).when(good == 1, F.when(toxic == 1, 1).otherwise(2)).alias("grade"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with `tail` (chance of a grade above 0) and `expected_grade`.

    Whole texts count. A null or empty text has no trigrams and gets the chances of the thresholds
    alone. Columns with these names are replaced; an empty table gives an empty result.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ("tail", "expected_grade")))
    new = [StructField("tail", DoubleType()), StructField("expected_grade", DoubleType())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tails = model.tails(*texts(part.column("text")))
                found = [pa.array(tails[:, 0]), pa.array(tails.sum(axis=1))]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, "tail", "expected_grade"])

    return docs.mapInArrow(rows, StructType([*docs.schema.fields, *new]))


def accepted(least: float = LEAST) -> Column:
    return F.col("tail") >= least
