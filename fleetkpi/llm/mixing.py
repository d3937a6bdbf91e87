"""Mixing sources to target weights by entropy balancing.

Among all rates for documents, those nearest to one copy each (in relative entropy) that give every
source its target of words have the form exp(multiplier of the source * size), here with sizes in
units of the source's mean and no more than `CAP` copies. The multipliers are the solution of a convex
dual with one unknown a source. Newton steps find them: each is an aggregation over the documents,
which enter as counts by source and size, and the multipliers stay in a table by source. Rates
become copies: whole ones, and one more for the documents that come first in a random order weighted
by the rest, until the source has its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS, NEAR = 80, 1e-9
#: A place in the random order has so many digits of so many bits.
DIGITS, BITS = 4, 12
#: Changes of one place that bring a source nearer to its target, one after the other.
CHANGES = 4


def sized(docs: DataFrame) -> DataFrame:
    """docs with `size`: runs of anything but white space in the text, none in a null one."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target, from rows (source, size).

    Sources in the order of code points, null last, take `weights` in turn and share all words by
    them. One that would pass `cap` times its size gets that, and the others share the rest by their
    weights: with sources by the share at which they are full, the full ones come first. One row a
    source goes through the windows.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("bigint"))
    full = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (left / open_weight).alias("level")
    ranked = weighted.select("*", level)
    # the first source that its share leaves below its cap sets the level of all after it
    reached = F.min(F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.struct(cap * F.col("source_size") / F.col("weight"), F.col("level"))))
    fits = ranked.withColumn("fit", reached.over(everything)["level"])
    goal = F.least(F.col("fit") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return fits.select("source", "source_size", goal.alias("target"))


def multipliers(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """source and multiplier; cells (source, size, n), goals (source, source_size, target).

    Each step adds up words and slope for all sources at once. A Newton step that leaves the bracket
    found so far gives way to its middle, or a doubling while it is open. Sources whose target is
    nothing or the cap need no solution and have null.
    """
    mean = cells.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    goals = goals.withColumnRenamed("source", "s")
    state = mean.join(goals, F.col("source").eqNullSafe(F.col("s"))).where(
        (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    )
    nothing = F.lit(None).cast("double")
    state = materialise(state.select("source", "mean", "target", F.lit(0.0).alias("multiplier"), nothing.alias("low"), nothing.alias("high"), F.lit(1.0).alias("gap")))
    cells = cells.where("size > 0").withColumnRenamed("source", "s")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        power = F.col("multiplier") * x
        free = power < math.log(cap)
        rate = F.when(free, F.exp(power)).otherwise(float(cap))
        words = F.col("size") * F.col("n")
        sums = (
            state.join(cells, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source", "mean", "target", "multiplier", "low", "high")
            .agg(F.sum(words * rate).alias("words"), F.sum(F.when(free, words * rate * x).otherwise(0.0)).alias("slope"))
        )
        short = F.col("target") - F.col("words")
        low = F.when(short > 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(short > 0, F.col("high")).otherwise(F.col("multiplier"))
        bounded = sums.select("*", short.alias("short"), low.alias("lo"), high.alias("hi"))
        newton = F.col("multiplier") + F.col("short") / F.col("slope")
        inside = (F.col("slope") > 0) & F.coalesce(newton > F.col("lo"), F.lit(True)) & F.coalesce(newton < F.col("hi"), F.lit(True))
        wide = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).when(
            F.col("hi").isNull(), F.greatest(F.col("multiplier") * 2, F.lit(1.0))
        ).otherwise(F.least(F.col("multiplier") * 2, F.lit(-1.0)))
        near = F.abs("short") <= NEAR * F.col("target")
        step = F.when(near, F.col("multiplier")).when(inside & (F.abs(newton - F.col("multiplier")) <= 8), newton).otherwise(wide)
        state = materialise(
            bounded.select("source", "mean", "target", step.alias("multiplier"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.when(near, 0.0).otherwise(1.0).alias("gap"))
        )
        if not state.where("gap > 0").limit(1).count():
            break
    return state.select("source", "mean", "multiplier")


def _place(rest: str) -> Column:
    """48 random bits of a document, drawn towards the front by the part of a copy that it is due."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))), 1, 12), 16, 10).cast("double")
    # a draw above the rest comes after all below it; both keep their order
    whole = float(1 << 48)
    scaled = (drawn + 1) / whole / F.greatest(F.col(rest), F.lit(1e-9))
    return F.least(F.floor(scaled / (1 + scaled) * whole), F.lit((1 << 48) - 1)).cast("bigint")


def copies(rates: DataFrame, goals: DataFrame) -> DataFrame:
    """rates (doc_id, source, size, rate, ...) with `copies`, whose words come next to each target.

    Documents follow each other by their place; digit by digit, counts of words by source and digit
    find the place at which a source has its words. Documents at one place are taken together or not.
    """
    placed = rates.withColumns({"whole": F.floor(F.col("rate") + 1e-9).cast("bigint")}).withColumn(
        "rest", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    )
    placed = placed.withColumn("place", F.when((F.col("rest") > 1e-9) & (F.col("size") > 0), _place("rest")))
    placed = materialise(placed)
    due = placed.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.sum(F.when(F.col("place").isNotNull(), F.col("size"))).alias("open"))
    due = due.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source")))
    cut = due.where("open > 0").select("s", (F.col("target") - F.col("sure")).alias("left"), F.lit(0).cast("bigint").alias("from_place"))
    within = placed.where("place is not null").select("source", "size", "place")
    for digit in range(DIGITS):
        shift = BITS * (DIGITS - 1 - digit)
        above = F.shiftright(F.col("place"), shift + BITS) == F.shiftright(F.col("from_place"), shift + BITS)
        sums = (
            within.join(cut, F.col("source").eqNullSafe(F.col("s")))
            .where(above)
            .groupBy("s", "left", F.shiftright("place", shift).alias("at"))
            .agg(F.sum("size").alias("words"))
        )
        ranked = sums.select("*", F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        # the last digit that begins before the source has its words
        last = F.max(F.when((F.col("before") == 0) | (F.col("before") <= F.col("left")), F.struct("at", "before", "words")))
        cut = ranked.groupBy("s", "left").agg(last.alias("last")).select(
            "s",
            (F.col("left") - F.col("last.before")).alias("left"),
            F.shiftleft(F.col("last.at"), shift).alias("from_place"),
            F.col("last.words").alias("words"),
        )
        cut = materialise(cut)
    chosen = placed.join(cut.withColumnRenamed("s", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    more = F.col("place").isNotNull() & (
        (F.col("place") < F.col("from_place")) | ((F.col("place") == F.col("from_place")) & (2 * F.col("left") >= F.col("words")))
    )
    chosen = materialise(chosen.withColumn("more", F.coalesce(more, F.lit(False))).select(*rates.columns, "whole", "place", "more"))
    for _ in range(CHANGES):
        chosen = _changed(chosen, goals)
    return chosen.withColumn("copies", F.col("whole") + F.col("more").cast("bigint")).select(*rates.columns, "copies")


def _changed(chosen: DataFrame, goals: DataFrame) -> DataFrame:
    """One place more or less in each source where that brings it nearer to its target."""
    taken = chosen.groupBy("source").agg(F.sum((F.col("whole") + F.col("more").cast("bigint")) * F.col("size")).alias("taken"))
    gap = taken.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).select("s", (F.col("target") - F.col("taken")).alias("gap"))
    places = chosen.where("place is not null").groupBy("source", "place", "more").agg(F.sum("size").alias("words"))
    after = F.abs(F.col("gap") - F.when(F.col("more"), -F.col("words")).otherwise(F.col("words")))
    flips = (
        places.join(gap, F.col("source").eqNullSafe(F.col("s")))
        .where(after < F.abs("gap"))
        .groupBy("s")
        .agg(F.min(F.struct(after.alias("after"), F.col("place").alias("place"))).alias("flip"))
        .select("s", F.col("flip.place").alias("flip"))
    )
    flipped = chosen.join(flips, F.col("source").eqNullSafe(F.col("s")), "left")
    more = F.col("more") != F.coalesce(F.col("place") == F.col("flip"), F.lit(False))
    return materialise(flipped.withColumn("more", more).select(*chosen.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken for each row of docs.

    docs has doc_id, text and source. A null or blank text has size 0 and stays as one copy of
    nothing. A null source is one source. Rows that share doc_id and size share their place in the
    random order, so reruns agree. Other columns are ignored; an empty table gives an empty result.
    """
    sizes = materialise(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"))
    goals = materialise(targets(sizes, weights, cap))
    cells = materialise(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    solved = multipliers(cells, goals, cap).withColumnRenamed("source", "m")
    plan = goals.withColumnRenamed("source", "g").join(solved, F.col("g").eqNullSafe(F.col("m")), "left")
    power = F.col("multiplier") * F.col("size") / F.col("mean")
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(F.col("target") <= 0, 0.0)
        .when(F.col("multiplier").isNull(), float(cap))
        .when(power < math.log(cap), F.exp(power))
        .otherwise(float(cap))
    )
    rates = sizes.join(plan, F.col("source").eqNullSafe(F.col("g"))).select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"))
    return copies(rates, goals).withColumn("taken", F.col("copies") * F.col("size"))
