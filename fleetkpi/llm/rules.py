"""Quality rules with thresholds that follow the data, by language and source.

Four rates describe a text: symbols by character, repeated lines by line, repeated words by word,
and characters by word. Their distribution in a language and source is kept as a quantile sketch, a
histogram on a fixed grid whose counts add up: sketches of sources merge to that of the language and
those to the one of all, and a group with few documents uses the merged one. Most texts have no
symbols and repeat nothing, so these rates are held against the highest tenth of the group: a document
goes when it lies beyond by far more than that tenth lies beyond the third quartile. The length of
words is held against both quartiles in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import materialise
from .words import _SPACE, Words, joined_hashes, mix, slices, texts

MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents that a group needs for quartiles of its own, and for a highest tenth.
ENOUGH, ENOUGH_HIGH = 100, 1000
#: How far beyond a quantile a limit lies, in distances to the next lower one.
FAR = 3
#: What is counted, by what, and parts of one in a cell of the grid. The last cell is open to the top.
RATES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "length": ("word_chars", "n_words", 10),
}
CELLS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _per_text(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))[offsets])


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns COUNTS of whole texts."""
    words = Words(data, offsets, lower=False)
    docs = len(offsets) - 1
    chars = _per_text(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets)
    symbols = _per_text(_SYMBOL[data], offsets)

    lines = Words(data, offsets, lower=False, between=_LINE)
    owner = np.repeat(np.arange(docs), lines.counts)
    full = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    owner, keys = owner[full], lines.hashes()[full]
    n_lines = np.bincount(owner, minlength=docs)
    _, first = np.unique(mix(keys + mix(owner.astype(np.uint64))), return_index=True)
    dup = n_lines - np.bincount(owner[first], minlength=docs)

    repeated = np.zeros(docs, np.int64)
    windows = joined_hashes(words.hashes(), 3)
    if len(windows):
        whose = np.repeat(np.arange(docs), words.counts)
        inside = np.flatnonzero(whose[2:] == whose[:-2])
        _, which, often = np.unique(
            mix(windows[inside] + mix(whose[inside].astype(np.uint64))), return_inverse=True, return_counts=True
        )
        found = inside[often[which] > 1]
        covered = np.zeros(len(whose), bool)
        for i in range(3):
            covered[found + i] = True
        repeated = np.bincount(whose[covered], minlength=docs)
    return [words.counts, chars, symbols, dup, repeated, n_lines]


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns COUNTS; null texts count as empty, columns of these names are replaced."""
    docs = docs.select(*(c for c in docs.columns if c not in COUNTS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = [i for i, name in enumerate(docs_columns) if name != "text"]
        for batch in batches:
            for part in slices(batch, "text"):
                found = [pa.array(x.astype(np.int64)) for x in counts(*texts(part.column("text")))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *found], [*(docs_columns[i] for i in keep), *COUNTS])

    docs_columns = docs.columns
    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(rows, StructType([*fields, *(StructField(c, LongType()) for c in COUNTS)]))


def base_failed() -> Column:
    """Rules with fixed cutoffs: too short, or for the most part repeated."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _cells() -> dict[str, Column]:
    part = lambda a, b, of: F.least(F.floor(F.lit(of) * F.col(a) / F.greatest(F.col(b), F.lit(1))), F.lit(CELLS)).cast("int")
    return {name: part(*by) for name, by in RATES.items()}


def noise(name: str) -> Column:
    """Cells that a document's rate is uncertain by: the root of its count, of one at least."""
    a, b, of = RATES[name]
    return F.lit(of) * F.sqrt(F.greatest(F.col(a), F.lit(1))) / F.greatest(F.col(b), F.lit(1))


def sketches(rates: DataFrame) -> DataFrame:
    """Counts by lang, source, rate and cell; adding counts merges sketches."""
    stacked = F.explode(F.array(*(F.struct(F.lit(name).alias("rate"), F.col(f"cell_{name}").alias("cell")) for name in RATES)))
    return (
        rates.where(~F.col("base_failed"))
        .select("lang", "source", stacked.alias("s"))
        .groupBy("lang", "source", "s.rate", "s.cell")
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """Quartiles and the edge of the highest tenth of each rate of each group, and its documents; a group has CELLS + 1 rows at most."""
    merged = sketch.groupBy(*by, "rate", "cell").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "rate")
    up = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select("*", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("docs"))
    at = lambda q: F.min(F.when(20 * F.col("upto") >= q * F.col("docs"), F.col("cell")))
    return ranked.groupBy(*by, "rate").agg(at(5).alias("q1"), at(15).alias("q3"), at(18).alias("high"), F.max("docs").alias("docs"))


def limits(sketch: DataFrame) -> DataFrame:
    """For each lang and source a row with `low`, `high` and `step` of all rates: the quantiles, and their distance."""
    own = quartiles(sketch, "lang", "source")
    parts = ("q1", "q3", "high")
    # merged sketches are small: one row a rate for a language, one for all
    lang = quartiles(sketch, "lang").select(F.col("lang").alias("lang_l"), F.col("rate").alias("rate_l"), *(F.col(c).alias(c + "_l") for c in (*parts, "docs")))
    total = quartiles(sketch).select(F.col("rate").alias("rate_t"), *(F.col(c).alias(c + "_t") for c in parts))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("rate") == F.col("rate_l"))).join(
        total, F.col("rate") == F.col("rate_t")
    )
    enough = F.when(F.col("rate") == "length", ENOUGH).otherwise(ENOUGH_HIGH)
    pick = lambda c: F.when(F.col("docs") >= enough, F.col(c)).when(F.col("docs_l") >= enough, F.col(c + "_l")).otherwise(F.col(c + "_t"))
    chosen = joined.select("lang", "source", "rate", *(pick(c).alias(c) for c in parts))
    one = lambda name, c: F.max(F.when(F.col("rate") == name, F.col(c)))
    out = []
    for name in RATES:
        low, high = ("q1", "q3") if name == "length" else ("q3", "high")
        out += [one(name, low).alias(f"low_{name}"), one(name, high).alias(f"high_{name}")]
        out.append((one(name, high) - one(name, low)).alias(f"step_{name}"))
    return chosen.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text, lang, source): the counts, base_failed and kept.

    Null or empty texts have no words and fail. Null languages and sources are groups like others.
    Rows with equal doc_ids are judged one by one. Other columns are ignored; an empty table gives
    an empty result.
    """
    rates = measured(docs.select("doc_id", "text", "lang", "source")).withColumn("base_failed", base_failed())
    rates = materialise(rates.withColumns({f"cell_{k}": v for k, v in _cells().items()}))
    bounds = limits(sketches(rates)).withColumnsRenamed({"lang": "lang_b", "source": "source_b"})
    joined = rates.join(
        bounds, F.col("lang").eqNullSafe(F.col("lang_b")) & F.col("source").eqNullSafe(F.col("source_b")), "left"
    )
    fine = F.lit(True)
    for name in RATES:
        cell, far = F.col(f"cell_{name}"), FAR * F.greatest(F.col(f"step_{name}"), noise(name))
        fine = fine & (cell <= F.col(f"high_{name}") + far)
        if name == "length":
            fine = fine & (cell >= F.col(f"low_{name}") - far)
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(fine, F.lit(False)))
    return joined.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"))
