"""Bounded samples of labelled documents for fitting a classifier at the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Distinct labels at most; more are an error.
MOST_LABELS = 64


def held_out() -> Column:
    """Rows kept from training: crc32 of the doc_id as text, divided by 5, leaves no rest."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def ordered(sample: DataFrame) -> DataFrame:
    return sample.orderBy(F.xxhash64("doc_id"), "doc_id")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame | None:
    """doc_id, label and whole text of at most `most` documents of each label; None without labels.

    labels (doc_id, `label`) may repeat a doc_id, lack documents or hold nulls; the largest label of
    a doc_id counts and rows without one are passed over. At most `most` ids of each label meet the
    documents, by a broadcast that this bounds.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    own = own.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    values = sorted(r["label"] for r in own.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if len(values) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} distinct values of {label}")
    chosen = None
    for value in values:
        part = ordered(own.where(F.col("label") == value)).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return None
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], list[int]]:
    """Texts and labels of the `labelled` documents, in the order of a hash of the id."""
    sample = labelled(docs, labels, label, most)
    rows = [] if sample is None else ordered(sample).select("text", "label").collect()
    return [r["text"] for r in rows], [r["label"] for r in rows]
