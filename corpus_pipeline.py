"""Documents to token ids: toxicity, quality, near duplicates, source weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; `run` writes each
result and reads it again, so a lost executor costs one stage at most. All stages but the last return
the columns of documents; other columns are dropped, whatever they are called. An empty table stays
empty in every stage. Rows are judged one by one, also where several share a doc_id or have none, and
a null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkpi.llm import bpe, mixing, ngram_join, quality, toxicity
from fleetkpi.session import use_small_batches
from fleetkpi.storage import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. A null, empty or blank text has no evidence and stays.

    Equal texts have equal scores, so repeated rows stay or go together; long texts are scored whole.
    """
    use_small_batches(spark)
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; equal texts stay or go together, a null text is an empty one."""
    use_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality.graded(labels))
    return quality.score(docs.select(*COLUMNS), model).where(quality.accepted()).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id.

    Rows that repeat a text are near duplicates as well, whether they share a doc_id or not: of several
    with the smallest doc_id one stays, and one without doc_id stays only if no other row of its group
    has one. Two texts under one doc_id are judged apart. Texts without words are no duplicates of
    anything and stay.
    """
    use_small_batches(spark)
    # a number for each row, read from what is written ever after
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS))
    groups = ngram_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    kept = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; a row without words once.

    A row's place in the mix follows from its doc_id and text, so rows that share a doc_id are taken on
    their own and rows that are equal in both share their number of copies.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    taken = mixing.mix(docs.select(key.alias("doc_id"), "source", "text")).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of")).agg(F.max("copies").cast("int").alias("copies"))
    same = (F.col("key") == F.col("id")) & F.col("source").eqNullSafe(F.col("of"))
    joined = docs.select(*COLUMNS, key.alias("key")).join(taken, same)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number, a row for each copy; a null or empty text has no ids."""
    use_small_batches(spark)
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", clean),
    ("quality", good),
    ("near duplicates", distinct),
    ("mixing", mixed),
    ("bpe", encoded),
]

# Two stages learn a model and one tokenises, which SQL cannot do; tests/llm/test_pipeline.py holds the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
