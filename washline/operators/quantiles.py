"""Exact interpolated quantiles that never gather a column in one place.

Up to ``SMALL`` values the built-in ``percentile`` is used. Beyond it the wanted ranks are
bracketed: doubles become 64-bit numbers of the same order, tasks count how many of them share their
first bits, and only the values that share those of a wanted rank are looked at by the next bits.
Each round is one scan and leaves a few thousandths of an interval; when it holds few values (``_few``), or
only one value, the exact ones are picked out of it by a task of its own. No sketch is kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, number, tidy
from .fit import compiled_methods, scalars

SMALL = 200_000
FETCH = 100_000
FETCH_MOST = 1 << 22  # values of an interval that one task sorts, 16 bytes each
FETCH_ALL = 1 << 28  # of all intervals
HELD = 1 << 21  # values of a task before they are sent
FIRST_BITS = 16
FIRST_CELLS = 1 << 21  # counters of a task in the first round, 24 bytes each
CELLS = 1 << 17  # and later, when most of them are in use


@dataclass(frozen=True)
class Interval:
    """The values of one column whose first ``depth`` bits are ``prefix``: ``size`` of them, ``below`` before them."""

    column: str
    prefix: int
    depth: int
    below: int
    size: int


def quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    counts: dict[str, int] | None = None,
    approx: bool = False,
    small: int | None = None,
    fetch: int | None = None,
    first: dict[str, dict[int, Interval]] | None = None,
) -> dict[str, dict[float, float | None]]:
    """Quantiles per column with linear interpolation; missing values are ignored.

    ``counts`` are the non-missing counts when the caller already has them, ``first`` the intervals that
    hold the wanted ranks of columns, if a scan of the caller found them. ``approx=True`` is
    one pass and returns elements of the column within 0.01 % of the rank.
    """
    if not wanted:
        return {}
    first, table = first or {}, df
    df = tidy(df, wanted)
    values = {name: number(df, name) for name in wanted}
    if approx:
        found = scalars(df, {
            name: F.percentile_approx(values[name], [float(p) for p in ps], 10_000)
            for name, ps in wanted.items()
        })
        return {n: dict(zip(ps, found[n] or [None] * len(ps))) for n, ps in wanted.items()}

    small = SMALL if small is None else small
    if counts is None:
        counts = scalars(df, {name: F.count(values[name]) for name in wanted})
    out: dict[str, dict[float, float | None]] = {}

    few = {name: ps for name, ps in wanted.items() if counts[name] <= small and name not in first}
    found = scalars(df, {
        name: F.percentile(values[name], F.array(*[F.lit(float(p)) for p in ps]))
        for name, ps in few.items()
    })
    for name, ps in few.items():
        out[name] = dict(zip(ps, found[name] or [None] * len(ps)))

    many = {name: ps for name, ps in wanted.items() if name not in few}
    if many:
        ranks = {
            name: {r for p in ps for r in ranks_of(p, counts[name])} for name, ps in many.items()
        }
        with compiled_methods(df.sparkSession):
            at = _order_statistics(table, ranks, counts, fetch, first)
        for name, ps in many.items():
            out[name] = {}
            for p in ps:
                lower, upper = ranks_of(p, counts[name])
                share = p * (counts[name] - 1) - lower
                a, b = at[name, lower], at[name, upper]
                # as ``percentile`` weighs them, infinities included
                out[name][p] = a if a == b else (1 - share) * a + share * b
    return out


def ranks_of(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _few(open_ranks: dict[Interval, set[int]]) -> int:
    """How many values an interval may hold to be fetched."""
    return max(FETCH, min(FETCH_MOST, FETCH_ALL // max(len(open_ranks), 1)))


def _order_statistics(df, ranks, counts, fetch, first) -> dict[tuple[str, int], float]:
    """The values at the given zero-based ranks of each column."""
    found: dict[tuple[str, int], float] = {}
    open_ranks: dict[Interval, set[int]] = defaultdict(set)
    for name, rs in ranks.items():
        for r in rs:
            open_ranks[first[name][r] if name in first else Interval(name, 0, 0, 0, counts[name])].add(r)
    while True:
        few = _few(open_ranks) if fetch is None else fetch
        wide = {i: rs for i, rs in open_ranks.items() if i.size > few}
        if not wide:
            break
        depth = min(i.depth for i in wide)  # those of a depth are cut together
        wide = {i: rs for i, rs in wide.items() if i.depth == depth}
        bits = bits_of(len(wide), CELLS if depth else FIRST_CELLS, depth)
        narrowed: dict[Interval, set[int]] = defaultdict(set)
        narrowed.update({i: rs for i, rs in open_ranks.items() if i not in wide})
        for interval, row in _rows_at(_tallies(df, list(wide), bits), wide):
            for r in row["ranks"]:
                if row["low"] == row["high"]:
                    found[interval.column, interval.below + r] = row["low"]
                    continue
                prefix = (interval.prefix << bits) | row["place"]
                part = Interval(
                    interval.column, prefix, depth + bits, interval.below + row["upto"] - row["n"], row["n"]
                )
                narrowed[part].add(interval.below + r)
        open_ranks = narrowed
    found.update(_fetch(df, open_ranks))
    return found


def bits_of(intervals: int, cells: int, depth: int = 0) -> int:
    """How many bits more are told apart when ``cells`` counters are shared by the intervals."""
    return min(max((cells // intervals).bit_length() - 1, 4), FIRST_BITS, 64 - depth)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; zeros of both signs are one."""
    b = (x + 0.0).view(np.int64)
    return (b ^ ((b >> 63) & np.int64((1 << 63) - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _doubles(bits: np.ndarray) -> np.ndarray:
    b = (bits ^ np.uint64(1 << 63)).view(np.int64)
    return (b ^ ((b >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def _by_column(intervals: list[Interval]) -> dict[str, list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each column and depth the sorted prefixes and the numbers of their intervals."""
    grouped = defaultdict(list)
    for k, i in enumerate(intervals):
        grouped[i.column, i.depth].append((i.prefix, k))
    out = defaultdict(list)
    for (name, depth), some in grouped.items():
        prefixes, numbers = zip(*sorted(some))
        out[name].append((depth, np.array(prefixes, np.uint64), np.array(numbers)))
    return out


def _inside(bits: np.ndarray, depth: int, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values inside the intervals, and the place of each one's prefix."""
    if not depth:
        return bits, np.zeros(len(bits), np.int64)
    first = bits >> np.uint64(64 - depth)
    if len(prefixes) == 1:
        own = bits[first == prefixes[0]]
        return own, np.zeros(len(own), np.int64)
    at = np.searchsorted(prefixes, first)
    hit = prefixes[np.minimum(at, len(prefixes) - 1)] == first
    return bits[hit], at[hit]


def _row(df: DataFrame, names) -> DataFrame:
    """The columns as one array a row, a matrix a batch."""
    return df.select(F.array(*[col(n).cast("double") for n in names]).alias("row"))


def _present_bits(batch: pa.RecordBatch, columns: int) -> Iterator[np.ndarray]:
    """The present values of each column."""
    rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
    for x in np.ascontiguousarray(rows.T):
        yield ordered_bits(x[~np.isnan(x)])  # NULL as well


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _tallies(df: DataFrame, intervals: list[Interval], bits: int) -> DataFrame:
    """``(interval, place, n, low, high)``: how many values of each interval have ``place`` as their next bits,
    and the least and greatest of them. A task sends one row a place."""
    wanted = _by_column(intervals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(len(intervals) << bits, np.int64)
        low, high = np.full(len(tally), (1 << 64) - 1, np.uint64), np.zeros(len(tally), np.uint64)
        for batch in batches:
            for every, of_column in zip(_present_bits(batch, len(wanted)), wanted.values()):
                for depth, prefixes, numbers in of_column:
                    own, at = _inside(every, depth, prefixes)
                    if not len(own):
                        continue
                    order = np.argsort(own)
                    own, at = own[order], at[order]
                    first = own >> np.uint64(64 - depth - bits)
                    start = run_starts(first)
                    place = (first[start] & np.uint64((1 << bits) - 1)).astype(np.int64)
                    cell = (numbers[at[start]] << bits) | place  # each once
                    end = np.append(start[1:], len(own))
                    tally[cell] += end - start
                    low[cell] = np.minimum(low[cell], own[start])
                    high[cell] = np.maximum(high[cell], own[end - 1])
        some = np.flatnonzero(tally)
        for at in range(0, len(some), 1 << 15):
            cells = some[at: at + (1 << 15)]
            yield pa.RecordBatch.from_arrays([
                pa.array((cells >> bits).astype(np.int32)), pa.array((cells & ((1 << bits) - 1)).astype(np.int32)),
                pa.array(tally[cells]), pa.array(_doubles(low[cells])), pa.array(_doubles(high[cells])),
            ], ["interval", "place", "n", "low", "high"])

    parts = _row(df, wanted).mapInArrow(run, "interval int, place int, n long, low double, high double")
    return parts.groupBy("interval", "place").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _rows_at(counted: DataFrame, open_ranks: dict[Interval, set[int]]):
    """``(interval, row)`` of the places that hold wanted ranks; ``ranks`` and ``upto`` count from the interval's
    first value. Only these rows reach the driver."""
    intervals = list(open_ranks)
    ranks = [F.array(*[F.lit(r - i.below) for r in sorted(open_ranks[i])]) for i in intervals]
    upto = F.sum("n").over(Window.partitionBy("interval").orderBy("place"))
    here = F.filter(
        F.get(F.array(*ranks), F.col("interval")),
        lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")),
    )
    picked = counted.withColumn("upto", upto).withColumn("ranks", here).where(F.size("ranks") > 0)
    return [(intervals[row["interval"]], row) for row in picked.collect()]


def _fetch(df, open_ranks) -> dict[tuple[str, int], float]:
    """The values at the ranks of intervals small enough to sort, each in a task of its own. Tasks send equal
    values once with their number; only the values at the wanted ranks reach the driver."""
    if not open_ranks:
        return {}
    intervals = list(open_ranks)
    ranks = [np.array(sorted(r - i.below for r in open_ranks[i])) for i in intervals]
    wanted = _by_column(intervals)

    def sent(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for own, of_column in zip(held, wanted.values()):
            if not own:
                continue
            every = np.sort(np.concatenate(own))
            for depth, prefixes, numbers in of_column:
                for prefix, number in zip(prefixes.tolist(), numbers.tolist()):
                    least, most = prefix << (64 - depth), ((prefix + 1) << (64 - depth)) - 1
                    a = np.searchsorted(every, np.uint64(least))
                    b = np.searchsorted(every, np.uint64(most), side="right")
                    if a == b:
                        continue
                    start = run_starts(every[a:b])
                    n = np.diff(np.append(start, b - a))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number], pa.int32()), pa.array([every[a:b][start].tobytes()], pa.binary()),
                        pa.array([b"" if len(n) == b - a else n.astype(np.int64).tobytes()], pa.binary()),
                    ], ["interval", "numbers", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in wanted]
        many = 0
        for batch in batches:
            for every, of_column, own in zip(_present_bits(batch, len(wanted)), wanted.values(), held):
                for depth, prefixes, _ in of_column:
                    own.append(_inside(every, depth, prefixes)[0])
                    many += len(own[-1])
            if many > HELD:
                yield from sent(held)
                held, many = [[] for _ in wanted], 0
        yield from sent(held)

    def picked(group: pa.Table) -> pa.Table:
        k = group["interval"][0].as_py()
        numbers = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["numbers"]]
        n = [np.frombuffer(x.as_buffer(), np.int64) for x in group["n"]]
        every = np.concatenate(numbers)
        if any(map(len, n)):
            upto = np.concatenate([c if len(c) else np.ones(len(x), np.int64) for x, c in zip(numbers, n)])
            order = np.argsort(every)
            at = np.searchsorted(np.cumsum(upto[order]), ranks[k], side="right")
            values = every[order][at]
        else:
            values = np.partition(every, ranks[k])[ranks[k]]
        return pa.table({
            "interval": pa.array(np.full(len(values), k, np.int32)), "rank": pa.array(ranks[k].astype(np.int64)),
            "value": pa.array(_doubles(values)),
        })

    inside = _row(df, wanted).mapInArrow(run, "interval int, numbers binary, n binary")
    rows = inside.groupBy("interval").applyInArrow(picked, "interval int, rank long, value double").collect()
    return {
        (intervals[r["interval"]].column, intervals[r["interval"]].below + r["rank"]): r["value"]
        for r in rows  # one row a wanted rank
    }
