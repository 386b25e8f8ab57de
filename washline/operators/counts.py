"""How often each value occurs, for many columns in one pass and one shuffle."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    LONG, col, distinct_key, field, is_scalar, present, string_columns,
)
from . import frequent
from .fit import compiled_methods, scalars
from .frequent import text_key
from .quantiles import FIRST_CELLS, Interval, bits_of, ordered_bits, ranks_of, run_starts

MAP_SIDE_LIMIT = 1000  # the row-number limit that Spark pushes before a shuffle
PARTS = 64
ROWS_PER_PART = 1 << 20
HELD = 1 << 22  # numbers of a task before they are looked at, and half of the distinct ones it keeps
AT_ONCE = 16  # columns whose distinct numbers a task keeps
HELD_TEXTS = 1 << 17
MANY_TEXTS = 20  # columns of texts that go as one value a row
LONG_BYTES = 256
NO_TEXT, TEXT_END = b"\xfe\xfdnull", b"\xff"  # bytes that no text in UTF-8 holds
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def slots(df: DataFrame, names: list[str], by_digest: bool = False) -> tuple[list[str], dict[str, int]]:
    """The types among the keys, and the place of each name's type in that list."""
    kinds = {
        n: "string" if by_digest and not is_scalar(field(df, n).dataType) else field(df, n).dataType.simpleString()
        for n in names
    }
    types = list(dict.fromkeys(kinds.values()))
    return types, {n: types.index(kinds[n]) for n in names}


def value_counts(
    df: DataFrame, names: list[str], with_missing: bool = False, by_digest: bool = False,
    layout: list[str] | None = None, wanted: DataFrame | None = None,
) -> DataFrame:
    """Columns ``column``, ``n`` and ``v0 .. vk``, one for each type: a row per column and value.

    ``v<i>`` holds the value on the rows of columns of the i-th type (``slots``) and is NULL
    elsewhere; with ``by_digest`` it holds the ``distinct_key``, so that long texts are not shuffled.
    Each row of the table becomes one narrow row per column; values are counted on the map side first,
    so a value that fills most of the table sends one row per task. ``layout`` are the columns that the
    types are those of, if more than ``names``; ``wanted`` is a short list of ``(column, key)``, as
    ``key_cells`` names them, that leaves out all other values.
    """
    types, place = slots(df, layout or names, by_digest)
    value = distinct_key if by_digest else present
    cells = []
    for n in names:
        key = value(df, n)
        typed = [
            (key if i == place[n] else F.lit(None).cast(t)).alias(f"v{i}") for i, t in enumerate(types)
        ]
        named = [] if wanted is None else [F.coalesce(text_key(df, n), F.lit("-")).alias("key")]
        cell = F.struct(F.lit(n).alias("column"), *typed, *named)
        cells.append(cell if with_missing else F.when(key.isNotNull(), cell))
    pairs = F.array(*cells) if with_missing else F.array_compact(F.array(*cells))
    rows = df.select(F.inline(pairs))
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted), ["column", "key"], "left_semi")
    return rows.groupBy("column", *[f"v{i}" for i in range(len(types))]).agg(F.count(F.lit(1)).alias("n"))


def key_cells(df: DataFrame, names: list[str], with_missing: bool) -> DataFrame:
    """``(column, key)``: a row for every value of the columns, missing ones as ``-`` if they count."""
    keys = {n: F.coalesce(text_key(df, n), F.lit("-")) if with_missing else text_key(df, n) for n in names}
    cells = [F.when(k.isNotNull(), F.struct(F.lit(n).alias("column"), k.alias("key"))) for n, k in keys.items()]
    return df.select(F.inline(F.array_compact(F.array(*cells))))


def slot_columns(counted: DataFrame) -> list[str]:
    return [c for c in counted.columns if c[0] == "v" and c[1:].isdigit()]


def plain_numbers(df: DataFrame) -> list[str]:
    """Columns whose distinct numbers are told apart by eight bytes."""
    return [f.name for f in df.schema if isinstance(f.dataType, NUMBERS)]


def plain_texts(df: DataFrame) -> list[str]:
    """String columns whose texts are equal only if their bytes are."""
    return [f.name for f in df.schema if f.dataType == T.StringType()]


def distinct_counts(df: DataFrame, names: list[str], approx: bool = False) -> dict[str, int]:
    """Distinct present values per column.

    Exact counts come from the counted values and not from ``count_distinct`` next to other
    aggregates, which would expand every row once per column with all its other inputs.
    """
    if not names:
        return {}
    if approx:
        return scalars(df, {n: F.approx_count_distinct(distinct_key(df, n)) for n in names})
    numbers = [n for n in plain_numbers(df) if n in names]
    texts = [n for n in plain_texts(df) if n in names]
    others = [n for n in names if n not in numbers and n not in texts]
    found = {n: 0 for n in names}
    if others:
        counted = value_counts(df, others, by_digest=True).groupBy("column").agg(F.count(F.lit(1)))
        found |= dict(counted.collect())  # one row per column, as below
    if numbers:
        found |= {n: x["distinct"] for n, x in number_summaries(df, numbers, numbers, moments=False).items()}
    if texts:
        found |= {n: x["distinct"] for n, x in text_summaries(df, texts).items()}
    return found


def _once(numbers: np.ndarray) -> np.ndarray:
    """The distinct ones, by sorting: faster on numbers than NumPy's own hash table."""
    ordered = np.sort(numbers)
    return ordered[run_starts(ordered)]


SUMMARY = "n long, nulls long, min double, max double, mean double, m2 double"


def number_summaries(
    df: DataFrame, names: list[str], distinct: Sequence[str] = (), moments: bool = True, points: Sequence[float] = ()
) -> dict[str, dict[str, Any]]:
    """For each numeric column, all from one scan: ``non_null``, ``nulls``, ``min``, ``max``, ``mean`` and ``std``;
    ``distinct`` for the columns named; ``first``, the intervals that hold the ranks of quantiles at ``points``.

    Rows go to the tasks' functions as two arrays, of doubles and of whole numbers, a matrix a batch. Distinct numbers
    are sent once a task, as far as it can hold them, eight bytes wide and in parts by a hash of the number, so that a
    part of a column holds about ``ROWS_PER_PART`` numbers however large the table. Above ``AT_ONCE`` columns of distinct
    numbers there is a scan for each so many, as numbers that a task cannot hold are shuffled more than once.
    """
    rows = df.count() if distinct else 0
    groups = -(-len(names) // AT_ONCE) if distinct else 1
    size = -(-len(names) // groups) if names else 1
    out: dict[str, dict[str, Any]] = {}
    for at in range(0, len(names), size):
        some = names[at: at + size]
        out |= _number_summaries(df, some, [n for n in some if n in distinct], moments, points, rows)
    return out


def _number_summaries(df, names, distinct, moments, points, rows) -> dict[str, dict[str, Any]]:
    out: dict[str, dict[str, Any]] = {
        n: {"non_null": 0, "nulls": 0, "min": None, "max": None, "mean": None, "std": None, "distinct": 0, "first": {}}
        for n in names
    }
    whole = [n for n in names if isinstance(field(df, n).dataType, WHOLE)]
    doubles = [n for n in names if n not in whole]
    every = doubles + whole
    parts = max(1, -(-rows // ROWS_PER_PART))
    tasks = min(len(distinct) * parts, len(distinct) * rows // (2 * HELD) + 1) + 1
    arrays = [F.array(*[col(n).cast("double") for n in doubles]).alias("doubles")] if doubles else []
    arrays += [F.array(*[col(n).cast("long") for n in whole]).alias("whole")] if whole else []
    bits = bits_of(len(every), FIRST_CELLS)
    sent = df.select(*arrays).mapInArrow(
        _numbers_sent(len(doubles), len(whole), [n in distinct for n in every], moments, bits if points else 0, parts),
        f"column int, part int, numbers binary, {SUMMARY}, places binary, tallies binary",
    )
    merged = sent.repartition(tasks, "column", "part").mapInArrow(
        _numbers_merged(list(points)),
        f"column int, distinct long, {SUMMARY}, ranks array<long>, place array<long>, below array<long>, size array<long>",
    )
    with compiled_methods(df.sparkSession):
        found = merged.groupBy("column").agg(
            F.sum("distinct").alias("distinct"),
            *[F.max(c).alias(c) for c in merged.columns[2:]],  # all are on one row
        ).collect()  # one row per column
    for row in found:
        n, own = every[row["column"]], row.asDict()
        out[n]["distinct"] = own["distinct"]
        if moments:
            out[n] |= {"non_null": own["n"], **{k: own[k] for k in ("nulls", "min", "max", "mean")}}
            out[n]["std"] = (own["m2"] / (own["n"] - 1)) ** 0.5 if own["n"] > 1 else None
        out[n]["first"] = {
            r: Interval(n, place, bits, below, size)
            for r, place, below, size in zip(*[own[k] or [] for k in ("ranks", "place", "below", "size")])
        }
    return out


def _summary(parts: list[tuple]) -> tuple:
    """``n, nulls, min, max, mean, m2`` of all values from those of parts; ``m2`` are squares around the mean."""
    nulls, some = sum(p[1] for p in parts), [p for p in parts if p[0]]
    if not some:
        return 0, nulls, None, None, None, None
    n, low, high, mean, m2 = (np.array([p[i] for p in some]) for i in (0, 2, 3, 4, 5))
    with np.errstate(all="ignore"):  # infinities
        centre = (n * mean).sum() / n.sum()
        off = mean - centre
        return int(n.sum()), nulls, low.min(), high.max(), centre, (m2 + n * off * off).sum()


def _summary_arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64()] * 2 + [pa.float64()] * 4
    return [pa.array(x, k, from_pandas=False) for x, k in zip(zip(*rows), kinds)]


def _numbers_sent(doubles: int, whole: int, distinct: list[bool], moments: bool, bits: int, parts: int):
    """The task's side of ``number_summaries``: rows of distinct numbers in parts, and one row a column, as part -1,
    of its summary and its tally of the values' first bits."""
    m, chunk, limit = doubles + whole, max(1, HELD // (doubles + whole)), HELD
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    names = ["column", "part", "numbers", "n", "nulls", "min", "max", "mean", "m2", "places", "tallies"]

    def packed(column: int, own: np.ndarray) -> pa.RecordBatch:
        ends = np.append(np.searchsorted(own, bounds), len(own))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        offsets = pa.py_buffer(np.append(0, ends[some] * 8).astype(np.int32))
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(own)])
        rest = [pa.nulls(len(some), k) for k in [pa.int64()] * 2 + [pa.float64()] * 4 + [pa.binary()] * 2]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), column, np.int32)), pa.array(some.astype(np.int32)), pieces, *rest], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real, integers = np.empty((doubles, chunk)), np.empty((whole, chunk), np.int64)
        gaps = np.empty((whole, chunk), bool)
        held: list[list[np.ndarray]] = [[] for _ in range(m)]
        seen: list[list[tuple]] = [[] for _ in range(m)]
        tally = np.zeros((m, 1 << bits), np.int64) if bits else None
        filled = 0

        def looked_at() -> None:
            for i in range(m):
                if i < doubles:
                    x = real[i, :filled]
                    x = x[~np.isnan(x)]  # NULL as well
                    number, key = x, x + 0.0  # one zero
                else:
                    key = integers[i - doubles, :filled]
                    key = key[~gaps[i - doubles, :filled]]
                    number = key.astype(np.float64)
                if not len(key):
                    seen[i].append((0, filled, None, None, None, None))
                    continue
                if moments or bits:
                    with np.errstate(all="ignore"):  # infinities
                        mean = number.mean()
                        off = number - mean
                        seen[i].append((len(key), filled - len(key), number.min(), number.max(), mean, off @ off))
                if bits:
                    first = ordered_bits(number) >> np.uint64(64 - bits)
                    tally[i] += np.bincount(first.view(np.int64), minlength=1 << bits)
                if distinct[i]:  # a product with an odd number is another number for each, in parts of even size
                    held[i].append(_once(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

        def crowded() -> Iterator[pa.RecordBatch]:
            """Beyond what is kept, columns go whose numbers hardly repeat, then others."""
            if sum(len(x) for own in held for x in own) <= 2 * limit:
                return
            kept, repeats = 0, {}
            for i, own in enumerate(held):
                if own:
                    held[i] = [_once(np.concatenate(own)) if len(own) > 1 else own[0]]
                    repeats[i] = sum(map(len, own)) / max(len(held[i][0]), 1)
                    kept += len(held[i][0])
            if kept <= 1.5 * limit:
                return
            for i in sorted(repeats, key=lambda i: (repeats[i] > 1.1, -len(held[i][0]))):
                if kept > limit and len(held[i][0]):
                    yield packed(i, held[i][0])
                    kept -= len(held[i][0])
                    held[i] = []

        for batch in batches:
            at = 0
            if doubles:
                some = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, doubles)
            if whole:
                flat = batch.column(1 if doubles else 0).flatten()
                missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, whole)
                integer = (flat.fill_null(0) if flat.null_count else flat).to_numpy().reshape(-1, whole)
            while at < batch.num_rows:
                n = min(chunk - filled, batch.num_rows - at)
                if doubles:
                    real[:, filled: filled + n] = some[at: at + n].T
                if whole:
                    integers[:, filled: filled + n] = integer[at: at + n].T
                    gaps[:, filled: filled + n] = missing[at: at + n].T
                filled, at = filled + n, at + n
                if filled == chunk:
                    looked_at()
                    filled = 0
                    yield from crowded()
        if filled:
            looked_at()
        for i, own in enumerate(held):
            if sum(map(len, own)):
                yield packed(i, _once(np.concatenate(own)) if len(own) > 1 else own[0])
        if not (moments or bits):
            return
        places = [np.flatnonzero(t) for t in tally] if bits else []
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, -1, np.int32)), pa.nulls(m, pa.binary()),
            *_summary_arrays([_summary(own) for own in seen]),
            pa.array([p.tobytes() for p in places] or [None] * m, pa.binary()),
            pa.array([t[p].tobytes() for t, p in zip(tally, places)] if bits else [None] * m, pa.binary()),
        ], names)

    return run


def _numbers_merged(points: list[float]):
    """How many distinct numbers the parts of columns hold, one row a column and task, and the summaries of columns."""
    def intervals(tallies: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[list[int], ...]:
        place, back = np.unique(np.concatenate([p for p, _ in tallies]), return_inverse=True)
        size = np.zeros(len(place), np.int64)
        np.add.at(size, back, np.concatenate([t for _, t in tallies]))
        upto = np.cumsum(size)
        ranks = sorted({r for p in points for r in ranks_of(p, n)})
        at = np.searchsorted(upto, ranks, side="right")
        return ranks, place[at].tolist(), (upto - size)[at].tolist(), size[at].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        summaries: dict[int, list[tuple]] = defaultdict(list)
        tallies: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            columns, parts, pieces, *rest = batch.columns
            for k, (c, part) in enumerate(zip(columns.to_pylist(), parts.to_pylist())):
                if part >= 0:
                    numbers[c, part].append(np.frombuffer(pieces[k].as_buffer(), np.uint64))
                    continue
                summaries[c].append(tuple(x[k].as_py() for x in rest[:6]))
                if points:
                    tallies[c].append(tuple(np.frombuffer(x[k].as_buffer(), np.int64) for x in rest[6:]))
        distinct: dict[int, int] = defaultdict(int)
        while numbers:
            (c, _), own = numbers.popitem()
            distinct[c] += len(_once(np.concatenate(own)) if len(own) > 1 else own[0])
        rows = []
        for c in distinct.keys() | summaries.keys():
            summary = _summary(summaries[c]) if c in summaries else (None,) * 6
            known = points and summary[0]
            rows.append((c, distinct.get(c, 0), *summary, *(intervals(tallies[c], summary[0]) if known else (None,) * 4)))
        if rows:
            c, n, *rest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()), pa.array(n, pa.int64()), *_summary_arrays([r[2:8] for r in rows]),
                 *[pa.array(x, pa.list_(pa.int64())) for x in rest[6:]]],
                ["column", "distinct", "n", "nulls", "min", "max", "mean", "m2", "ranks", "place", "below", "size"],
            )

    return run


def text_summaries(df: DataFrame, names: list[str]) -> dict[str, dict[str, int]]:
    """``non_null``, ``nulls`` and ``distinct`` of string columns. Above ``MANY_TEXTS`` columns all come from one scan in
    which the texts of a row are one value; ``distinct`` alone for fewer, or for texts that are not UTF-8."""
    many = len(names) > MANY_TEXTS
    with compiled_methods(df.sparkSession):
        if many:
            rows = _packed_texts(df, names).collect()  # one row per column
            if not any(r["odd"] for r in rows):
                out = {n: {"non_null": 0, "nulls": 0, "distinct": 0} for n in names}
                return out | {names[r["column"]]: r.asDict() for r in rows}
        found = dict(_distinct_texts(df, names).collect())  # one row per column
    return {n: {"distinct": found.get(i, 0)} for i, n in enumerate(names)}


def _packed_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, non_null, nulls, distinct, odd)``: ``odd`` where a text holds the byte that ends texts. Each row's texts are
    one value of bytes; tasks send each text of a column once, as long as they are few, long ones by digest."""
    m, held_most = len(names), HELD_TEXTS
    end, gap = F.lit(bytearray(TEXT_END)), F.lit(bytearray(NO_TEXT))
    texts = F.concat(*[x for n in names for x in (F.coalesce(col(n).cast("binary"), gap), end)]).alias("texts")
    missing, odd = NO_TEXT + TEXT_END, (-1, 0, 0, None)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["column", "non_null", "nulls", "key"]
        )

    def split(rows: pa.Array) -> pa.Array | None:
        """The texts of all rows; None if some row holds more of them than there are columns."""
        offsets, data = (np.frombuffer(b, t) for b, t in zip(rows.buffers()[1:], (np.int32, np.uint8)))
        offsets = offsets[rows.offset: rows.offset + len(rows) + 1]
        ends = np.flatnonzero(data[offsets[0]: offsets[-1]] == TEXT_END[0]) + 1 + offsets[0]
        if len(ends) != len(rows) * m or not np.array_equal(ends[m - 1::m], offsets[1:]):
            return None
        bounds = pa.py_buffer(np.append(offsets[0], ends).astype(np.int32))
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, bounds, rows.buffers()[2]])

    def keys(texts: pa.Array) -> pa.Array:
        """The texts, long ones as digests: no text begins with the first byte of one."""
        if not len(texts) or pc.max(pc.binary_length(texts)).as_py() <= LONG_BYTES:
            return texts
        return pa.array([x if len(x) <= LONG_BYTES else NO_TEXT[:1] + hashlib.sha256(x).digest()
                         for x in texts.to_pylist()], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array | None] = [None] * m
        rows, nulls = 0, np.zeros(m, np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for i, own in enumerate(held):
                if own is not None and len(own):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(own), i, np.int32)), pa.array(np.zeros(len(own), np.int64)),
                        pa.array(np.zeros(len(own), np.int64)), own,
                    ], ["column", "non_null", "nulls", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = split(batch.column(0).cast(pa.binary()))
            if texts is None:
                yield table([odd])
                return
            rows += batch.num_rows
            coded = texts.dictionary_encode()
            codes = coded.indices.to_numpy().reshape(-1, m).T
            no_text = pc.index(coded.dictionary, pa.scalar(missing, pa.binary())).as_py()
            short = keys(coded.dictionary)
            for i in range(m):
                here = np.bincount(codes[i], minlength=len(short))
                if no_text >= 0:
                    nulls[i] += here[no_text]
                    here[no_text] = 0
                own = short.take(pa.array(np.flatnonzero(here)))
                held[i] = own if held[i] is None else pc.unique(pa.concat_arrays([held[i], own]))
            if sum(map(len, held)) > held_most:
                yield from sent()
                held = [None] * m
        yield from sent()
        if rows:
            yield table([(i, rows - n, n, None) for i, n in enumerate(nulls.tolist())])

    found = df.select(texts).mapInArrow(run, "column int, non_null long, nulls long, key binary")
    once = found.groupBy("column", "key").agg(F.sum("non_null").alias("non_null"), F.sum("nulls").alias("nulls"))
    return once.groupBy("column").agg(
        F.sum("non_null").alias("non_null"), F.sum("nulls").alias("nulls"), F.count("key").alias("distinct"),
        F.bool_or(F.col("column") < 0).alias("odd"),
    )


def _distinct_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, n)`` by place in ``names``. Tasks send the keys of each text once, as long as they are few."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            for i, own in enumerate(held):
                if own is not None and len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), own], ["column", "key"])

        held: list[pa.Array | None] = [None] * len(names)
        for batch in batches:
            for i, c in enumerate(batch.columns):
                own = pc.unique(c.drop_null())
                held[i] = own if held[i] is None else pc.unique(pa.concat_arrays([held[i], own]))
            if sum(map(len, held)) > HELD_TEXTS:
                yield from sent()
                held = [None] * len(names)
        yield from sent()

    keys = df.select(*[distinct_key(df, n).alias(f"c{i}") for i, n in enumerate(names)])
    return keys.mapInArrow(run, "column int, key string").distinct().groupBy("column").agg(
        F.count(F.lit(1)).alias("n")
    )


def long_columns(df: DataFrame, names: list[str]) -> list[str]:
    """String columns with a value above ``LONG`` characters."""
    strings = [n for n in names if n in string_columns(df)]
    longest = scalars(df, {n: F.max(F.length(col(n))) for n in strings})
    return [n for n in strings if (longest[n] or 0) > LONG]


def picked_values(df: DataFrame, names: list[str], picked: DataFrame, long: list[str]) -> DataFrame:
    """Add ``value`` to a bounded selection of ``by_digest`` counts.

    A key is the value itself unless that is long; the few long ones picked are looked up by
    their digest in one more scan of the long columns.
    """
    keyed = picked.withColumn("__key", value_text(picked))
    if not long:
        return keyed.withColumnRenamed("__key", "value")
    texts = df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), distinct_key(df, n).alias("__key"), col(n).alias("__text"))
        for n in long
    ]))).where(F.startswith("__key", F.lit("#")))
    wanted = keyed.where(F.startswith("__key", F.lit("#"))).select("column", "__key")
    found = (
        texts.join(F.broadcast(wanted), ["column", "__key"])
        .groupBy("column", "__key").agg(F.any_value("__text").alias("__text"))
    )
    return keyed.join(F.broadcast(found), ["column", "__key"], "left").withColumn(
        "value", F.coalesce("__text", "__key")
    ).drop("__key", "__text")


def value_text(counted: DataFrame) -> Column:
    """The value of a ``value_counts`` row as text."""
    return F.coalesce(*[F.col(c).cast("string") for c in slot_columns(counted)])


def top_counts(
    df: DataFrame, names: list[str], k: int, with_missing: bool = False, by_digest: bool = False
) -> DataFrame:
    """The ``k`` most frequent values per column with ``rank``; ties go to the smaller value.

    On large tables summaries name the few values that can be among them (``frequent``); only columns
    without frequent values, or with few distinct ones, have all of them counted.
    """
    sure, wanted = set(), None
    if names and df.count() > frequent.SMALL_ROWS:
        sure, wanted = frequent.candidates(key_cells(df, names, with_missing), k)
    even = [n for n in names if n not in sure]
    parts = [value_counts(df, even, with_missing, by_digest, names)] if even or not sure else []
    if sure:
        parts.append(value_counts(df, [n for n in names if n in sure], with_missing, by_digest, names, wanted))
    counted = reduce(DataFrame.unionByName, parts)
    order = [F.desc("n"), *[F.col(c).asc_nulls_last() for c in slot_columns(counted)]]
    return ranked(counted, ["column"], order, k)


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with ``rank``. Spark limits a group on the map side up to a
    size of its own; beyond that the rows are limited in parts first, so no task sorts a whole group."""
    if k > MAP_SIDE_LIMIT:
        part = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(PARTS)).alias("__part")
        inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
        rows = rows.select("*", part).withColumn("__rank", inside).where(F.col("__rank") <= k)
        rows = rows.drop("__part", "__rank")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def modes(df: DataFrame, names: list[str]) -> dict[str, Any]:
    """Most frequent value per column, smallest on ties; a column without values is left out."""
    if not names:
        return {}
    place = slots(df, names)[1]
    rows = top_counts(df, names, 1).collect()  # one row per column
    return {r["column"]: r[f"v{place[r['column']]}"] for r in rows}


def count_of(df: DataFrame, name: str) -> DataFrame:
    """Counts of one column as ``(value, n)``, missing values included."""
    return df.groupBy(present(df, name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
