"""Order statistics over the closed trailing 30 and 60 days of every visit, in one pass.

A RANGE frame of Spark computes its aggregates anew for each row, which is quadratic on a dense
machine. Here rows arrive sorted by machine (or slice of it) and time, and many of them are worked on
together: where each frame begins is searched for all rows at once, sums are differences of running
sums, and the k-th smallest value of every frame comes from one wavelet matrix of the values, a bit
of the rank at a time, so the work grows with the rows and hardly with how many a frame has. Between
one lot of rows and the next a task keeps the last 60 days of one machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.clock import DAY_US

#: Sums are kept in whole steps of this size, so that a difference of them has no rounding error.
STEP = 2.0**-40
#: Rows that are worked on together.
ROWS = 1 << 15

STATISTICS = {
    "ingresos_30d": "bigint",
    "ingresos_60d": "bigint",
    "tbf_med_30d": "double",
    "tbf_std_30d": "double",
    "tbf_min_30d": "double",
    "tbf_max_30d": "double",
    "tbf_med_60d_rango": "double",
    "tbf_trend": "double",
    "sistemas_unicos_30d": "int",
    "sistema_dominante_30d": "int",
    "sistemas_unicos_60d": "int",
    "mttr_med_30d": "double",
    "mttr_std_30d": "double",
    "mttr_max_30d": "double",
    "mttr_med_90d_rango": "double",
}
DDL = ", ".join(f"{name} {kind}" for name, kind in STATISTICS.items())
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
INPUTS = ("_at", "tbf_dias", "ciclo_horas", "sistema_afectado", "_i")


def smallest(values: np.ndarray, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of values[begin:end] for many ranges at once; each range holds more than k."""
    distinct, codes = np.unique(values, return_inverse=True)
    begin, end, k, found = begin.copy(), end.copy(), k.copy(), np.zeros(len(begin), np.int64)
    for level in range(int(len(distinct) - 1).bit_length() - 1, -1, -1):
        ones = (codes >> level) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~ones)))
        low, high = zeros[begin], zeros[end]
        up = k >= high - low
        k = np.where(up, k - (high - low), k)
        found += up.astype(np.int64) << level
        begin, end = np.where(up, zeros[-1] + begin - low, low), np.where(up, zeros[-1] + end - high, high)
        codes = np.concatenate((codes[~ones], codes[ones]))
    return distinct[found] if len(found) else np.zeros(0)


def _steps(values: np.ndarray) -> tuple[np.ndarray, float]:
    """Whole numbers that stand for the values, and what one is worth; either kind gives the same results."""
    if 0 < len(values) < 1 << 20 and (values == np.rint(values)).all() and np.abs(values).max() < 1 << 20:
        return values.astype(np.int64), 1.0
    return np.array([round(v / STEP) for v in values.tolist()], object), STEP


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))


@dataclass
class _Values:
    """A column without what is null or not finite; `upto` counts what is left before each row."""

    kept: np.ndarray
    upto: np.ndarray

    @classmethod
    def of(cls, column: np.ndarray) -> _Values:
        fine = np.isfinite(column)
        return cls(column[fine], np.concatenate(([0], np.cumsum(fine))))

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.upto[begin], self.upto[end]

    def ranked(self, wanted: list[tuple[np.ndarray, np.ndarray, str]], default: float) -> list[np.ndarray]:
        """Median, least or largest value of each list of ranges, `default` for empty ones."""
        asked, sizes = [], []
        for begin, end, what in wanted:
            n = end - begin
            some = np.flatnonzero(n > 0)
            n, begin, end = n[some], begin[some], end[some]
            places = {"median": [(n - 1) // 2, n // 2], "min": [n * 0], "max": [n - 1]}[what]
            sizes.append((some, len(places)))
            asked += [(begin, end, k) for k in places]
        found = smallest(self.kept, *(np.concatenate(x) for x in zip(*asked, strict=True)))
        out, at = [], 0
        for (begin, _, _), (some, places) in zip(wanted, sizes, strict=True):
            own = found[at : at + places * len(some)].reshape(places, len(some))
            at += own.size
            column = np.full(len(begin), default)
            column[some] = 0.5 * own[0] + 0.5 * own[1] if places == 2 else own[0]
            out.append(column)
        return out

    def deviation(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the sample; one value has none (NaN here), no value has 0."""
        steps, worth = _steps(self.kept)
        sums, squares = _running(steps), _running(steps * steps)
        n = end - begin
        some = np.flatnonzero(n > 1)
        a, b, m = begin[some], end[some], n[some]
        total = sums[b] - sums[a]
        spread = (m.astype(object) * (squares[b] - squares[a]) - total.astype(object) * total).astype(np.float64)
        out = np.where(n == 1, np.nan, 0.0)
        out[some] = np.sqrt(spread / (m * (m - 1.0))) * worth
        return out

    def slope(self, begin: np.ndarray, end: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Of a least-squares line through (index, value), 0 below three values."""
        steps, worth = _steps(self.kept)
        x, xx, y, xy = (_running(v) for v in (index, index * index, steps, index * steps))
        n = end - begin
        some = np.flatnonzero(n > 2)
        a, b, m = begin[some], end[some], n[some].astype(object)
        x, xx, y, xy = ((v[b] - v[a]).astype(object) for v in (x, xx, y, xy))
        out = np.zeros(len(begin))
        spread = (m * xx - x * x).astype(np.float64)
        rise = (m * xy - x * y).astype(np.float64)
        fine = spread != 0
        out[some[fine]] = rise[fine] / spread[fine] * worth
        return out


def _systems(codes: np.ndarray, group: np.ndarray, frames: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct systems of each frame and how often its most frequent one occurs; code -1 is none."""
    known = np.flatnonzero(codes >= 0)
    many = int(codes.max(initial=0)) + 1
    pairs, place = np.unique((group[known] - group[0]) * many + codes[known], return_inverse=True)
    # systems are numbered within their machine, so there are as many passes as the machine with most has systems
    first = np.searchsorted(pairs // many, pairs // many)
    own = np.full(len(codes), -1)
    own[known] = (np.arange(len(pairs)) - first)[place]
    out = [(np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)) for b, _ in frames]
    for number in range(int(own.max(initial=-1)) + 1):
        upto = np.concatenate(([0], np.cumsum(own == number)))
        for (begin, end), (distinct, most) in zip(frames, out, strict=True):
            times = upto[end] - upto[begin]
            distinct += times > 0
            np.maximum(most, times, out=most)
    return out


@dataclass
class _Rows:
    """Visits in the order of machine and time: number of the machine, instant, values, system, index."""

    group: np.ndarray
    at: np.ndarray
    tbf: np.ndarray
    hours: np.ndarray
    system: np.ndarray
    index: np.ndarray

    def part(self, begin: int, end: int) -> _Rows:
        return _Rows(*(getattr(self, f)[begin:end] for f in self.__dataclass_fields__))

    def begin(self, days: int) -> np.ndarray:
        """First row of each row's frame."""
        near = self.at - self.at.min()
        span = int(near.max()) + 1
        base = (self.group - self.group[0]) * span
        return np.searchsorted(base + near, base + np.maximum(near - days * DAY_US, 0))

    def end(self) -> np.ndarray:
        """Row after each row's frame: those at one instant see each other."""
        last = np.ones(len(self.at), bool)
        last[:-1] = (self.at[1:] != self.at[:-1]) | (self.group[1:] != self.group[:-1])
        ends = np.flatnonzero(last) + 1
        return ends[np.searchsorted(ends, np.arange(len(self.at)), side="right")]


def _frame_statistics(rows: _Rows, new: int) -> list[np.ndarray]:
    """STATISTICS of all rows from number `new` on."""
    own = slice(new, None)
    begin30, begin60, end = rows.begin(30)[own], rows.begin(60)[own], rows.end()[own]
    tbf, hours = _Values.of(rows.tbf), _Values.of(rows.hours)
    tbf30, tbf60 = tbf.ranges(begin30, end), tbf.ranges(begin60, end)
    hours30, hours60 = hours.ranges(begin30, end), hours.ranges(begin60, end)
    median, least, largest, median60 = tbf.ranked([(*tbf30, "median"), (*tbf30, "min"), (*tbf30, "max"), (*tbf60, "median")], 0.0)
    usual, longest, usual60 = hours.ranked([(*hours30, "median"), (*hours30, "max"), (*hours60, "median")], 24.0)
    (near, most), (far, _) = _systems(rows.system, rows.group, [(begin30, end), (begin60, end)])
    # an index only has to count on within a machine, and small numbers keep the sums small
    first = np.searchsorted(rows.group, rows.group)
    index = (rows.index - rows.index[first])[np.isfinite(rows.tbf)]
    if len(index) >= 1 << 20:
        index = index.astype(object)
    return [
        end - begin30,
        end - begin60,
        median,
        tbf.deviation(*tbf30),
        least,
        largest,
        median60,
        tbf.slope(*tbf60, index),
        near,
        most,
        far,
        usual,
        hours.deviation(*hours30),
        longest,
        usual60,
    ]


def _numbers(column: pa.ChunkedArray, missing: float | int) -> np.ndarray:
    return column.combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values get equal numbers, null gets -1."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _read(table: pa.Table, keys: tuple[str, ...]) -> _Rows:
    """Rows without an instant are a machine of their own."""
    at = table.column("_at")
    marks = [_codes(table.column(k)) for k in keys] + [_numbers(at.is_null(), False)]
    new = np.zeros(table.num_rows, np.int64)
    for mark in marks:
        new[1:] |= mark[1:] != mark[:-1]
    return _Rows(
        np.cumsum(new),
        _numbers(at, 0),
        _numbers(table.column("tbf_dias"), np.nan),
        _numbers(table.column("ciclo_horas"), np.nan),
        _codes(table.column("sistema_afectado")),
        _numbers(table.column("_i"), 0),
    )


def _lots(rows: _Rows) -> Iterator[tuple[int, int]]:
    """Rows that can be searched together: machine and instant fit into one whole number."""
    span = int(rows.at.max()) - int(rows.at.min()) + 1
    most = max(1, (1 << 62) // span)
    groups = rows.group[-1] + 1
    edges = [*np.searchsorted(rows.group, np.arange(0, groups, most)).tolist(), len(rows.at)]
    yield from zip(edges, edges[1:], strict=False)


def trailing_statistics(keys: tuple[str, ...], rows_at_once: int = ROWS):
    """For mapInArrow over rows sorted by `keys` and time: the rows with STATISTICS behind them.

    Visits at one instant see each other. Rows without an instant see each other alone.
    """

    def finished(table: pa.Table, rows: _Rows, new: int, until: int) -> Iterator[pa.RecordBatch]:
        for begin, end in _lots(rows.part(0, until)):
            if end <= new:
                continue
            lot = rows.part(begin, end)
            columns = _frame_statistics(lot, max(0, new - begin))
            added = table.slice(max(begin, new), end - max(begin, new))
            for (name, kind), column in zip(STATISTICS.items(), columns, strict=True):
                # a deviation that one value does not have is null
                array = pa.array(column, _ARROW[kind], from_pandas=kind == "double")
                added = added.append_column(name, array)
            yield from added.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        old = count = 0  # of the rows held, those that are done and only seen by later ones
        enough = rows_at_once
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count - old < enough:
                continue
            enough = 2 * enough
            table = pa.Table.from_batches(held)
            rows = _read(table, keys)
            # the last instant may go on in the next batch
            until = int(np.flatnonzero((rows.group == rows.group[-1]) & (rows.at == rows.at[-1]))[0])
            if until > old:
                yield from finished(table, rows, old, until)
                kept = (rows.group == rows.group[-1]) & (rows.at >= rows.at[-1] - 60 * DAY_US)
                first = int(np.flatnonzero(kept)[0])
                held, old, count = table.slice(first).to_batches(), until - first, table.num_rows - first
                enough = max(rows_at_once, 2 * (count - old))
        if count > old:
            table = pa.Table.from_batches(held)
            rows = _read(table, keys)
            yield from finished(table, rows, old, len(rows.at))

    return run
