"""Exact medians of groups that are too large for the value map of one task.

``percentile`` keeps every distinct value of a group in one buffer. Here a quantile sketch, which adds
up from task to task, brackets the wanted rank first; a second pass counts what lies below the bracket
and, value by value, what lies inside. Only the inside of a bracket, a thousandth of a group, comes
together. For running medians (all rows up to each of many steps) the values are cut into bins at
quantiles of the group; counts by step and bin say in which bin the median of each step lies, and only
the values of those bins are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .timeline import NO_CUTS, Cuts

#: Relative accuracy of the sketch, and how far the bracket reaches beyond it.
ACCURACY, REACH = 10_000, 3
#: Bins of a group for running medians.
BINS = 256


def long_form(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """One row (keys, name, value) for each value that is not null."""
    pairs = F.create_map(*[part for name, c in columns.items() for part in (F.lit(name), c.cast("double"))])
    return df.select(*keys, F.explode(pairs).alias("name", "value")).filter(F.col("value").isNotNull())


def _between(low: Column, high: Column) -> Column:
    return low * 0.5 + high * 0.5


def selected_medians(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, median) of a table (keys, name, value) without nulls; exact.

    Values of one group are never together in a task, but for those within its bracket. Groups are few:
    the whole log, or machines that are cut.
    """
    by = [*keys, "name"]
    slack = REACH / ACCURACY
    edges = F.percentile_approx("value", [0.5 - slack, 0.5 + slack], ACCURACY)
    groups = values.groupBy(*by).agg(edges.alias("_e"), F.count("*").alias("_n"))
    bracket = groups.select(*by, "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    # a join by the group would bring each group into one task
    inside = values.join(F.broadcast(bracket), by).filter(F.col("value") <= F.col("_hi"))
    counted = inside.groupBy(*by, "_n", F.when(F.col("value") >= F.col("_lo"), F.col("value")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto))
    return _picked(ranked, by)


def _picked(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values at the two middle ranks, averaged; ``_upto`` counts a value and all before it."""
    rank = (F.col("_n") - 1) / 2

    def at(place: Column) -> Column:
        reached = (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
        return F.max(F.when(reached, F.col("_v")))

    picked = ranked.groupBy(*by).agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_b"))
    found = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), _between(F.col("_a"), F.col("_b")))
    missed = F.raise_error(F.lit("a median lies outside its bracket")).cast("double")
    return picked.select(*by, F.coalesce(found, missed).alias("median"))


def global_medians(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row with the exact median of each column over the whole table, null where it has no values."""
    # only the values are written, and read by both passes
    found = selected_medians(materialise(long_form(df, [], columns)), [])
    return found.agg(*[F.max(F.when(F.col("name") == name, F.col("median"))).alias(name) for name in columns])


def machine_aggregates(
    df: DataFrame, plain: Sequence[Column], medians: dict[str, Column], cuts: Cuts = NO_CUTS, key: str = "codigo"
) -> DataFrame:
    """``plain`` aggregates and medians of every machine.

    A machine that is not cut keeps a map of its values; one that is cut has its medians selected.
    """
    if not cuts:
        return df.groupBy(key).agg(*plain, *[F.percentile(c, F.lit(0.5)).alias(name) for name, c in medians.items()])
    flagged = df.join(cuts.machines.select(key, F.lit(True).alias("_cut")), key, "left")
    kept = [F.percentile(F.when(F.col("_cut").isNull(), c), F.lit(0.5)).alias(name) for name, c in medians.items()]
    rows = flagged.groupBy(key).agg(*plain, *kept)
    busy = selected_medians(materialise(long_form(flagged.filter("_cut"), [key], medians)), [key])
    wide = busy.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("median"))).alias(f"_{name}") for name in medians])
    joined = rows.join(wide, key, "left")
    return joined.withColumns({name: F.coalesce(f"_{name}", name) for name in medians}).drop(*[f"_{name}" for name in medians])


def running_medians(values: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """(keys, name, step, median): exact medians of all values up to each step that has any.

    ``values`` is (keys, name, step, value) without nulls and is read twice. Groups are few, as in
    ``selected_medians``.
    """
    by = [*keys, "name"]
    cuts = F.percentile_approx("value", [i / BINS for i in range(1, BINS)], ACCURACY)
    edges = values.groupBy(*by).agg(F.array_distinct(cuts).alias("_edges"))
    # a join by the group would bring each group into one task
    binned = values.join(F.broadcast(edges), by).select(
        *by, step, F.col("value").alias("_v"), F.size(F.filter("_edges", lambda e: e < F.col("value"))).alias("_bin")
    )
    counts = materialise(binned.groupBy(*by, step, "_bin", "_v").agg(F.count("*").alias("_c")))
    # a row for each step and bin of a group, whatever it holds
    by_bin = counts.groupBy(*by, step, "_bin").agg(F.sum("_c").alias("_c"))
    steps = by_bin.select(*by, step).distinct()
    bins = by_bin.groupBy(*by).agg(F.collect_set("_bin").alias("_bins"))
    grid = steps.join(bins, by).select(*by, step, F.explode("_bins").alias("_bin")).join(by_bin, [*by, step, "_bin"], "left")
    over_steps = Window.partitionBy(*by, "_bin").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    over_bins = Window.partitionBy(*by, step).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, step)
    upto = grid.withColumn("_c", F.coalesce(F.sum("_c").over(over_steps), F.lit(0)))
    upto = upto.withColumns({"_upto": F.sum("_c").over(over_bins), "_n": F.sum("_c").over(whole)})
    rank = (F.col("_n") - 1) / 2
    before = F.col("_upto") - F.col("_c")
    holds = (F.col("_c") > 0) & (before <= F.ceil(rank)) & (F.col("_upto") > F.floor(rank))
    wanted = upto.filter(holds).select(*by, "_bin", F.col(step).alias("_step"), "_n", before.alias("_before"))
    # a value meets the steps from its own on whose median lies in its bin
    met = counts.join(wanted, [*by, "_bin"]).filter(F.col(step) <= F.col("_step"))
    summed = met.groupBy(*by, "_step", "_n", "_before", "_v").agg(F.sum("_c").alias("_c"))
    inside = Window.partitionBy(*by, "_step", "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = summed.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    return _picked(ranked, [*by, "_step"]).withColumnRenamed("_step", step)
