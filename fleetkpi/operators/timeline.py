"""Per-machine ordered work that stays balanced when one machine owns most of the log.

A window partitioned by machine puts a whole machine into one task. Machines above
``rows_per_slice`` visits are therefore cut into time slices of about that many rows, and the
window runs per (machine, slice). What a slice has to know about the rest of its machine
reaches it as extra rows that are dropped afterwards:

* ``with_neighbours``: the last (or first) k rows before (after) the slice, for lag, lead and
  ROWS frames;
* ``running_totals``: one row with the sums of everything before the slice, so that a running
  sum inside the slice is the running sum of the machine;
* ``spread``: the rows within N days of the slice, for RANGE frames over values that do not
  add up (medians, extremes).

``find_cuts`` decides once per log which machines to cut, and where, by the position of their rows. Logs without such a machine keep the
plain one-shuffle window. Results are the same either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.clock import DAY_US, micros
from ..storage import materialise

ROWS_PER_SLICE = 250_000
#: Visits that one task of a window gets on the average; logs that are no larger are left to Spark.
ROWS_PER_TASK = 100_000
# Slices begin at the first visit of an hour, so the count behind a cut has a row per machine and hour at most.
BIN_US = 3_600_000_000
_BOUNDS = ("_starts", "_hi")


@dataclass(frozen=True)
class Cuts:
    """Machines cut into slices: key, first instant of each slice (``_starts``) and last entry (``_hi``).

    A written table that is joined without a hint, so that Spark broadcasts it only where it is small.
    ``tasks`` says over how many tasks the log's windows are dealt; None leaves it to Spark.
    """

    machines: DataFrame | None = None
    tasks: int | None = None

    def __bool__(self) -> bool:
        return self.machines is not None


NO_CUTS = Cuts()


def find_cuts(
    df: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
    key: str = "codigo",
    ts: str = "fecha_in",
    rows_per_task: int = ROWS_PER_TASK,
) -> Cuts:
    """Cut every machine above ``rows_per_slice`` visits by the position of its rows.

    Visits are counted with map-side combining, then by hour for the busy machines alone. A slice
    ends with the hour in which its rows are reached; visits at one instant stay together. The same
    count says over how many tasks a log above ``rows_per_task`` visits is dealt.
    """
    at = micros(F.col(ts))
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    busiest = F.max(F.when(F.col(key).isNotNull(), F.col("_n")))
    whole = counts.agg(F.sum("_n").alias("rows"), busiest.alias("busiest")).first()
    rows, tasks = whole["rows"] or 0, None
    if rows > rows_per_task:
        tasks = max(-(-rows // rows_per_task), df.sparkSession.sparkContext.defaultParallelism)
    if (whole["busiest"] or 0) <= rows_per_slice:
        return Cuts(tasks=tasks)
    busy = counts.filter((F.col("_n") > rows_per_slice) & F.col(key).isNotNull()).select(key)
    hours = (
        df.join(busy, key, "left_semi")
        .groupBy(key, F.floor(at / F.lit(BIN_US)).alias("_bin"))
        .agg(F.count("*").alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    )
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    position = F.coalesce(F.sum("_n").over(before), F.lit(0))
    slices = (
        hours.withColumn("_k", F.floor(position / F.lit(rows_per_slice)))
        .groupBy(key, "_k")
        .agg(F.min("_first").alias("_start"), F.max("_last").alias("_end"))
    )
    listed = slices.groupBy(key).agg(
        F.sort_array(F.collect_list("_start")).alias("_starts"), F.max("_end").alias("_hi")
    )
    return Cuts(materialise(listed), tasks)


def dealt(df: DataFrame, cuts: Cuts, key: str = "codigo") -> DataFrame:
    """Bring each machine (or slice of it) together, in as many tasks as the size of the log asks for.

    Windows and aggregations by machine then need no exchange of their own. Spark sizes its tasks by
    compressed bytes, or takes a fixed number of them, while windows hold visits many times as large.
    """
    if not cuts.tasks:
        return df
    return df.repartition(cuts.tasks, key, *(["_slice"] if cuts else []))


def _slice_of(at: Column) -> Column:
    """Slice number of an instant; 0 for machines that are not cut and before the first slice."""
    passed = F.size(F.filter("_starts", lambda start: start <= at))
    number = F.greatest(F.lit(0), passed - F.lit(1))
    return F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(number).cast("bigint")


def machine_window(
    cuts: Cuts, *order: Column | str, within: Sequence[str] = (), key: str = "codigo"
) -> WindowSpec:
    """Window per machine, or per slice of it where machines are cut."""
    spec = Window.partitionBy(key, *within, *(["_slice"] if cuts else []))
    return spec.orderBy(*order) if order else spec


def with_neighbours(
    df: DataFrame,
    cuts: Cuts,
    before: int,
    after: int = 0,
    key: str = "codigo",
    ts: str = "fecha_in",
    tie: str = "visit_id",
) -> DataFrame:
    """Lend every slice its ``before``/``after`` neighbouring rows.

    Adds ``_lent`` (and ``_slice`` with cuts); ``own_rows`` removes both again.
    """
    if not cuts:
        return dealt(df, cuts, key).withColumn("_lent", F.lit(False))
    joined = df.join(cuts.machines, key, "left")
    cut = joined.withColumn("_slice", _slice_of(micros(F.col(ts))))
    parts = [cut.withColumn("_lent", F.lit(False))]
    hot = cut.filter(F.col("_starts").isNotNull())
    names = [c for c in cut.columns if c not in (key, "_slice", ts, tie)]

    def lend(count: int, backwards: bool) -> DataFrame:
        order = [F.col(ts).desc(), F.col(tie).desc()] if backwards else [F.col(ts), F.col(tie)]
        rank = F.row_number().over(machine_window(cuts, *order, key=key))
        # the rank limit is applied before the shuffle, so only slice edges travel
        edge = hot.withColumn("_r", rank).filter(F.col("_r") <= count)
        packed = F.struct(ts, tie, *names)
        ends = edge.groupBy(key, "_slice").agg(F.sort_array(F.collect_list(packed)).alias("_e"))
        spec = Window.partitionBy(key).orderBy("_slice")
        frame = spec.rowsBetween(-count, -1) if backwards else spec.rowsBetween(1, count)
        pool = F.flatten(F.collect_list("_e").over(frame))
        start = F.greatest(F.lit(1), F.size("_p") - F.lit(count - 1)) if backwards else F.lit(1)
        return (
            ends.withColumn("_p", pool)
            .select(key, "_slice", F.explode(F.slice("_p", start, F.lit(count))).alias("_x"))
            .select(key, "_slice", *[F.col("_x")[c].alias(c) for c in (ts, tie, *names)])
            .withColumn("_lent", F.lit(True))
        )

    if before:
        parts.append(lend(before, backwards=True))
    if after:
        parts.append(lend(after, backwards=False))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return dealt(merged, cuts, key)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop lent rows and the slicing columns."""
    helpers = [c for c in ("_lent", "_slice", *_BOUNDS) if c in df.columns]
    return df.filter(~F.col("_lent")).drop(*helpers)


def settled(df: DataFrame, cuts: Cuts) -> DataFrame:
    """Write a stage's result where the next stage reads it more than once."""
    return materialise(df) if cuts else df


def written(df: DataFrame, cuts: Cuts, key: str = "codigo") -> DataFrame:
    """Write a log that several plans read; read again it is dealt as before."""
    table = materialise(df)
    return table if cuts else dealt(table, cuts, key)


def spread(
    df: DataFrame,
    cuts: Cuts,
    back_days: int,
    ahead_days: int = 0,
    key: str = "codigo",
    ts: str = "fecha_in",
) -> DataFrame:
    """Lend every slice the rows within the given days of it.

    A row goes to its own slice and to those that begin within the reach.
    """
    if not cuts:
        return df.withColumn("_lent", F.lit(False))
    at = micros(F.col(ts))
    joined = df.join(cuts.machines, key, "left")
    first = _slice_of(at - F.lit(ahead_days * DAY_US))
    last = _slice_of(at + F.lit(back_days * DAY_US))
    lent = (
        joined.withColumn("_own", _slice_of(at))
        .withColumn("_slice", F.explode(F.sequence(first, last)))
        .withColumn("_lent", F.col("_slice") != F.col("_own"))
        .drop("_own")
    )
    return dealt(lent, cuts, key)


def running_totals(
    events: DataFrame,
    cuts: Cuts,
    weights: Sequence[str],
    key: str = "codigo",
    within: Sequence[str] = (),
) -> DataFrame:
    """Replace each weight by its running sum per key up to and including ``_at``.

    ``events`` carries ``_at`` (epoch micros) and ``_real`` (false for events that only count).
    Frames are unbounded-preceding: linear work however dense a machine is. A slice gets the
    sums of everything before it as one row.
    """
    keys = [key, *within]
    merged = events
    if cuts:
        joined = events.join(cuts.machines, key, "left")
        # what happens after the last visit of a cut machine cannot reach any visit
        kept = joined.filter(F.col("_hi").isNull() | (F.col("_at") <= F.col("_hi")))
        cut = kept.withColumn("_slice", _slice_of(F.col("_at")))
        sums = (
            cut.filter(F.col("_starts").isNotNull())
            .groupBy(*keys, "_slice", "_starts")
            .agg(*[F.sum(w).alias(w) for w in weights])
        )
        # one row per slice, far fewer than rows
        earlier = (
            Window.partitionBy(*keys)
            .orderBy("_slice")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = sums.select(
            *keys,
            "_slice",
            (F.element_at("_starts", F.col("_slice").cast("int") + 1) - 1).alias("_at"),
            F.lit(False).alias("_real"),
            *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(w) for w in weights],
        )
        merged = dealt(cut.drop(*_BOUNDS).unionByName(carried, allowMissingColumns=True), cuts, key)
    upto = machine_window(cuts, "_at", within=within, key=key)
    summed = merged.select(
        *[c for c in merged.columns if c not in weights],
        *[F.sum(w).over(upto).alias(w) for w in weights],
    )
    return summed.filter(F.col("_real")).drop("_real", "_at", "_slice")
