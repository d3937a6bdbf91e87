"""Daily series of many machines at once: filled, smoothed and capped, with a linear trend and weekday effects.

Rows arrive sorted by machine and day, and a lot of machines is worked on together: all their days lie in one array, one machine
behind the other. A lot holds about `DAYS` days; a single machine has at most one row per calendar day. Where a step needs order
statistics, only the days that are not 0 are sorted. Series leave a task packed, a row for each machine.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# the functions travel with the job, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Days of a lot.
DAYS = 1 << 19
INPUTS = ["codigo", "dia", "horas", "visitas", "clase"]
HOURS = "codigo string, clase string, desde date, y array<double>"
SERIES = f"{HOURS}, dias bigint, media double, desviacion double, maximo double, dias_con_uso bigint"
EFFECTS = [f"efecto_{d}" for d in range(7)]  # Monday first
FITS = "codigo string, pendiente double, dia_medio double, media double, ultimo_dia date, dias bigint, " + ", ".join(f"{e} double" for e in EFFECTS)


@dataclass
class Lot:
    """Machines with their first days, the values of all their days, and where each machine begins among them."""

    names: np.ndarray
    classes: np.ndarray
    first: np.ndarray
    y: np.ndarray
    offsets: np.ndarray

    @property
    def length(self) -> np.ndarray:
        return np.diff(self.offsets)

    def each(self, values: np.ndarray) -> np.ndarray:
        """A value of each machine on all its days."""
        return np.repeat(values, self.length)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.offsets[:-1])


def _kept(lot: Lot, keep: np.ndarray) -> Lot:
    return Lot(
        lot.names[keep], lot.classes[keep], lot.first[keep], lot.y[lot.each(keep)], np.concatenate(([0], np.cumsum(lot.length[keep])))
    )


def _filled(names: np.ndarray, day: np.ndarray, hours: np.ndarray, visits: np.ndarray, classes: np.ndarray, least: int) -> Iterator[Lot]:
    """Whole machines with at least so many visits, 0 on the days between their own."""
    heads = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    ends = np.append(heads[1:], len(names))
    enough = np.flatnonzero(np.add.reduceat(visits, heads) >= least)
    heads, ends = heads[enough], ends[enough]
    length = (day[ends - 1] - day[heads] + 1).astype(np.int64)
    before = np.cumsum(length) - length
    for lot in np.unique(before // DAYS):
        own = np.flatnonzero(before // DAYS == lot)
        offsets = np.concatenate(([0], np.cumsum(length[own])))
        begin, end = heads[own], ends[own]
        many = end - begin
        rows = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        y = np.zeros(offsets[-1])
        y[np.repeat(offsets[:-1] - day[begin], many) + day[rows]] = hours[rows]
        yield Lot(names[begin], classes[end - 1], day[begin], y, offsets)


def _lots(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Lot]:
    """Lots of whole machines; the last machine of a batch waits for the next one."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        day = batch.column(1).cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
        return [batch.column(0).to_numpy(zero_copy_only=False), day, *rest]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
        if held and (last or held[-1][0][-1] != now[0][0]):
            yield from _filled(*_together([*held, [c[:last] for c in now]]), least)
            held = []
        elif last:
            yield from _filled(*[c[:last] for c in now], least)
        held.append([c[last:] for c in now])
    if held:
        yield from _filled(*_together(held), least)


def _together(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(own) for own in zip(*parts, strict=True)]


def _smoothed(lot: Lot) -> np.ndarray:
    """Mean of a day and the two before it."""
    y, begin = lot.y, lot.offsets[:-1]
    out = y.copy()
    out[2:] = (y[:-2] + y[1:-1] + y[2:]) / 3
    second = begin[lot.length > 1]
    out[second + 1] = (y[second] + y[second + 1]) / 2
    out[begin] = y[begin]
    return out


def _percentile(lot: Lot, values: np.ndarray, share: float) -> np.ndarray:
    """Exact percentile of each machine, between the two values next to its rank."""
    n = lot.length
    other = np.flatnonzero(values)
    machine = np.repeat(np.arange(len(n)), n)[other]
    ordered = values[other]
    ordered = np.append(ordered[np.lexsort((ordered, machine))], 0.0)
    many = np.bincount(machine, minlength=len(n))
    start, zeros = np.cumsum(many) - many, n - many
    below = np.bincount(machine[values[other] < 0], minlength=len(n))

    def at(k: np.ndarray) -> np.ndarray:
        place = np.where(k < below, k, k - zeros)
        inside = (k < below) | (k >= below + zeros)
        return np.where(inside, ordered[np.where(inside, start + place, 0)], 0.0)

    position = (n - 1) * share
    low, high = np.floor(position), np.ceil(position)
    one, two = at(low.astype(np.int64)), at(high.astype(np.int64))
    return np.where(one == two, one, (high - position) * one + (position - low) * two)


def _usage(lot: Lot) -> tuple[Lot, dict[str, np.ndarray]]:
    """Smoothed days, none above the machine's 99th percentile, of machines with some variation; and their statistics."""
    smooth = _smoothed(lot)
    capped = np.minimum(smooth, lot.each(_percentile(lot, smooth, 0.99)))
    n = lot.length
    mean = lot.total(capped) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        deviation = np.sqrt(lot.total((capped - lot.each(mean)) ** 2) / (n - 1))
    keep = (deviation > 0.1) & (n >= 10)
    statistics = {
        "dias": n, "media": mean, "desviacion": deviation, "maximo": np.maximum.reduceat(capped, lot.offsets[:-1]),
        "dias_con_uso": lot.total((capped > 0).astype(np.int64)),
    }
    lot = Lot(lot.names, lot.classes, lot.first, capped, lot.offsets)
    return _kept(lot, keep), {name: values[keep] for name, values in statistics.items()}


def _fitted(lot: Lot, mean: np.ndarray) -> dict[str, np.ndarray]:
    """Trend over the days, and of each weekday the mean of what the trend leaves."""
    n = lot.length
    machine = np.repeat(np.arange(len(n)), n)
    day = np.arange(lot.offsets[-1]) + lot.each(lot.first - lot.offsets[:-1])
    middle = lot.total(day) / n
    x = day - middle[machine]
    slope = lot.total(x * (lot.y - mean[machine])) / lot.total(x * x)
    # day 0 was a Thursday
    cell = machine * 7 + (day + 3) % 7
    many = np.bincount(cell, minlength=7 * len(n)).reshape(-1, 7)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.bincount(cell, lot.y, 7 * len(n)).reshape(-1, 7) / many
        at = np.bincount(cell, x, 7 * len(n)).reshape(-1, 7) / many
    effects = np.where(many > 0, own - (mean[:, None] + slope[:, None] * at), 0.0)
    last = lot.first + n - 1
    return {"pendiente": slope, "dia_medio": middle, "media": mean, "ultimo_dia": last, "dias": n, **dict(zip(EFFECTS, effects.T, strict=True))}


def _texts(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.string())


def _dates(days: np.ndarray) -> pa.Array:
    return pa.array(days.astype(np.int32)).cast(pa.date32())


def _packed(lot: Lot, statistics: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    y = pa.ListArray.from_arrays(pa.array(lot.offsets.astype(np.int32)), pa.array(lot.y))
    parts = {"codigo": _texts(lot.names), "clase": _texts(lot.classes), "desde": _dates(lot.first), "y": y}
    return pa.RecordBatch.from_pydict(parts | {name: pa.array(values) for name, values in (statistics or {}).items()})


def daily(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hours of every day as `HOURS`; takes `INPUTS` sorted by machine and day."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, least):
            yield _packed(lot)

    return rows


def usage(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same smoothed and capped, as `SERIES`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, least):
            yield _packed(*_usage(lot))

    return rows


def trends(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Models of the smoothed and capped series, as `FITS`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _lots(batches, least):
            lot, statistics = _usage(whole)
            if not len(lot.names):
                continue
            found = _fitted(lot, statistics["media"])
            last = _dates(found.pop("ultimo_dia"))
            fits = {name: pa.array(values) for name, values in found.items()}
            yield pa.RecordBatch.from_pydict({"codigo": _texts(lot.names), **fits, "ultimo_dia": last}).select([f.split()[0] for f in FITS.split(", ")])

    return rows
