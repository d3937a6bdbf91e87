"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of characters. All distinct blocks are sorted and each gets
its rank as an integer name; then names at places 2i and 2i + 1 form a pair, all distinct pairs are
sorted and named by rank, and so on until one name is left of a text. Equal names at one level mean
equal pairs a level below and in the end equal blocks, so the level and the last name tell texts apart
without any chance of a collision. A text of one block has its name at level 0, a missing right
neighbour is called 0, and names begin with 1.

Ranks come from a range partitioning: a row's place within its sorted partition plus the rows of all
partitions before, so names depend on the texts alone. Contents move twice, to be told apart and to be
sorted. Between a block and its name only 128 bits of the block travel, and they are proven to be
different for different blocks of this input first; if they were not, others are taken.

A block, a pair or a text that very many rows have is looked up through salted keys: rows meet their
name in as many tasks as there are shuffle partitions, and one row a salt fetches the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Characters of a block.
BLOCK = 4096
#: Other 128 bits are tried so often if two blocks have the same.
TRIES = 4


def blocks_of(text: Column, size: int = BLOCK) -> Column:
    """Blocks of `size` characters in order, the last one shorter; an empty text is one empty block."""
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(found)


def block_keys(block: Column, attempt: int) -> Column:
    """128 bits of a block that stand for it once they are proven to be different for all blocks."""
    seed = F.lit(attempt)
    return F.struct(F.xxhash64(seed, block).alias("k1"), F.xxhash64(block, seed, F.lit("second")).alias("k2"))


def ranked(distinct: DataFrame, by: list[str], kept: list[Column]) -> DataFrame:
    """The columns `kept` of distinct rows and `name`, their rank from 1 in the order of all of `by`; written."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = distinct.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialise(spread.select(*kept, F.spark_partition_id().alias("part_"), inside.alias("inside_")))
    # one row for each partition of the sort
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part_").agg(F.count("*").alias("rows_"))
    starts = sizes.select("part_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("start_"))
    return placed.join(starts, "part_").withColumn("name", F.col("start_") + F.col("inside_") + 1).drop("part_", "inside_", "start_")


def salt(df: DataFrame, *by: str) -> Column:
    """A number below that of the shuffle partitions, made from columns that tell rows apart."""
    return F.pmod(F.xxhash64(*by), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int")


def looked_up(rows: DataFrame, names: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """rows with the columns of names (one row a key), however many rows share a key; `row` tells rows apart."""
    rows = rows.withColumn("salt_", salt(rows, *row))
    asked = rows.select(*keys, "salt_").distinct()
    return rows.join(asked.join(names, keys), [*keys, "salt_"]).drop("salt_")


def _level_0(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of texts (row_, doc_id, text_sha256, n_blocks), and the named blocks (row_, place, name)."""
    for attempt in range(TRIES):
        parts = blocks_of(F.col("text"), size)
        # one pass numbers the rows; the numbers are read from what it wrote ever after
        signed = materialise(
            docs.select(
                F.monotonically_increasing_id().alias("row_"),
                "doc_id",
                F.sha2(F.col("text"), 256).alias("text_sha256"),
                F.transform(parts, lambda b: block_keys(b, attempt)).alias("keys"),
            )
        )
        contents = docs.select(F.explode(parts).alias("block")).distinct()
        # written without the blocks: from here on their keys are enough
        keyed = ranked(contents, ["block"], [block_keys(F.col("block"), attempt).alias("k")]).select("k.k1", "k.k2", "name")
        if keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            continue
        at = signed.select("row_", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("place", "k"))
        at = at.select("row_", "n_blocks", "place", "k.k1", "k.k2")
        named = looked_up(at, keyed, ["k1", "k2"], ["row_", "place"]).select("row_", "n_blocks", "place", "name")
        return signed.select("row_", "doc_id", "text_sha256"), materialise(named)
    raise RuntimeError(f"{TRIES} hashes of 128 bits were equal for different blocks")


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """row_, doc_id, text_sha256, level and name for each row of docs (doc_id, text, null-free texts).

    Rows have the same level and name when their texts are the same, and only then.
    """
    rows, named = _level_0(docs, size)
    last = None
    level = 0
    while True:
        done = named.where("n_blocks = 1").select("row_", F.lit(level).alias("level"), "name")
        last = done if last is None else last.unionByName(done)
        more = named.where("n_blocks > 1")
        if not more.limit(1).count():
            break
        left, right = (F.max(F.when(F.col("place") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = more.groupBy("row_", F.expr("(n_blocks + 1) div 2").cast("int").alias("n_blocks"), F.expr("place div 2").cast("int").alias("place")).agg(
            left.alias("left_"), F.coalesce(right, F.lit(0)).alias("right_")
        )
        pairs = materialise(pairs)
        both = ["left_", "right_"]
        names = ranked(pairs.select(*both).distinct(), both, [F.col(c) for c in both])
        named = materialise(looked_up(pairs, names, both, ["row_", "place"]).select("row_", "n_blocks", "place", "name"))
        level += 1
    return rows.join(last, "row_")


def exact_duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row for each row of docs (doc_id, text).

    Texts are equal when all their characters are; a null text counts as empty, and empty texts are
    equal to each other. Of equal texts the row with the largest doc_id stays; where several rows have
    that doc_id one of them does, and a row without doc_id stays only if no row of its text has one
    (keep_id is null then). Texts of any length are read whole. Other columns are ignored; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = materialise(identities(docs, size))
    own = named.withColumn("salt_", salt(named, "row_"))
    best = F.max(F.struct("doc_id", "row_"))
    partly = own.groupBy("level", "name", "salt_").agg(best.alias("best"), F.count("*").alias("n"))
    groups = partly.groupBy("level", "name").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    groups = partly.select("level", "name", "salt_").join(groups, ["level", "name"])
    return own.join(groups, ["level", "name", "salt_"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_") == F.col("best.row_")).alias("kept"),
        "text_sha256",
    )
