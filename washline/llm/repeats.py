"""Exact repeats of at least ``length`` bytes across all documents.

Repeats are found where they can meet. Every window of ``length`` bytes has an anchor: the smallest
hash among its ``ANCHOR``-byte strings, the leftmost on ties. Consecutive windows with one anchor
form a run; equal windows always have equal anchors. Runs are grouped by the anchor's hash, equal
runs are counted on the map side and travel as one, and only anchors that occur with different
surroundings need their bytes: those of one run per class are read again.

The bytes of such classes are compared through a Burrows-Wheeler transform, a few megabytes at a time:
starting from the empty prefix, backward extension visits the boundaries between suffix-array
intervals in order of increasing common prefix, and stops at ``length``. Positions without a
boundary by then share their first ``length`` bytes with the suffix before them.

An anchor with more than ``crowd`` different runs (in a passage that very many documents share, with an
edit nearby in some) is grouped again by longer strings: its runs are cut in two by how far before the
anchor a window starts, so that the windows of a half hold more bytes in common, and again, until groups
are small or the halves are single windows. Equal halves travel as one, so no group of bytes grows with
the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, written

LENGTH = 200
ANCHOR = 32
CROWD = 2048
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
PLACE_BITS = 24
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
    up[1:], down[1:] = np.uint64(BASE), np.uint64(inverse)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def runs(text: bytes, length: int, powers=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first window start, windows)`` of the runs of one text."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(ANCHOR, length)
    width = length - k + 1
    out = []
    up, down = powers or _powers(min(n, PIECE) + 1)
    for at in range(0, n - length + 1, PIECE - length + 1):
        piece = np.frombuffer(text, np.uint8, min(PIECE, n - at), at).astype(np.uint64)
        if len(piece) < length:
            break
        grams = _grams(piece, k, (up, down))
        packed = _with_places(grams)
        least = _sliding_least(packed, width)
        chosen = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        many = np.diff(np.append(first, len(chosen)))
        out.append((grams[chosen[first]], first + at, many))
    return tuple(np.concatenate(x) for x in zip(*out))


def _grams(piece: np.ndarray, k: int, powers) -> np.ndarray:
    """The hash of every ``k`` consecutive bytes."""
    up, down = powers
    with np.errstate(over="ignore"):
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * down[: len(piece) - k + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
    return grams


def _with_places(grams: np.ndarray) -> np.ndarray:
    """Hashes whose low bits are their places, so that of equal ones the leftmost is the smallest."""
    places = np.arange(len(grams), dtype=np.uint64)
    return (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, MASK, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    """``(anchor, digest, row, start, windows)`` for every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(PIECE + 1)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            held, count = [], 0
            texts = byte_values(batch.column(1))
            for row, text in zip(batch.column(0).to_pylist(), texts):
                anchors, starts, many = runs(text, length, powers)
                if not len(anchors):
                    continue
                ends = (starts + many + length - 1).tolist()
                view = memoryview(text)
                digests = [digest(view[s:e]) for s, e in zip(starts.tolist(), ends)]
                held.append((anchors, np.array(digests, np.uint64), np.full(len(anchors), row), starts, many))
                count += len(anchors)
                if count > 50_000:
                    yield _run_batch(held)
                    held, count = [], 0
            if held:
                yield _run_batch(held)

    return docs.mapInArrow(run, "anchor long, digest long, row long, start long, windows int")


def _run_batch(held: list) -> pa.RecordBatch:
    anchors, digests, rows, starts, many = (np.concatenate(x) for x in zip(*held))
    return pa.RecordBatch.from_arrays(
        [_signed(anchors), _signed(digests), pa.array(rows.astype(np.int64)),
         pa.array(starts.astype(np.int64)), pa.array(many.astype(np.int32))],
        ["anchor", "digest", "row", "start", "windows"],
    )


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of symbols below 256 and unique terminators of 256 and above, by doubling:
    only suffixes whose order is still open are sorted again."""
    n = len(text)
    symbols = np.where(text < 256, text + 1, 0).astype(np.uint64)
    key, span = np.zeros(n, dtype=np.uint64), 0
    open_ended = np.ones(n, dtype=bool)
    # seven symbols of nine bits; a terminator ends the key and is told apart by its place
    padded = np.concatenate((symbols, np.zeros(7, np.uint64)))
    for j in range(7):
        digit = np.where(open_ended, padded[j: j + n], 0).astype(np.uint64)
        key = (key << np.uint64(9)) | digit
        open_ended &= padded[j: j + n] > 0
    span = 7
    order = np.argsort(key)
    ranked = key[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = _tied(head)
    closed = at[~open_ended[order[at]]]  # these are told apart by the place of their terminator
    members = order[closed]
    order[closed] = members[np.argsort((rank[members] << 32) | members)]
    rank[order[closed]] = closed
    at = at[open_ended[order[at]]]
    while len(at):
        members = order[at]
        pair = (rank[members] << 32) | rank[members + span]
        sub = np.argsort(pair)
        members, pair = members[sub], pair[sub]
        order[at] = members
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[members] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[_tied(new)]
        span *= 2
    return order


def _tied(head: np.ndarray) -> np.ndarray:
    """The places that share a key with a neighbour."""
    tied = ~head
    tied[:-1] |= ~head[1:]
    return np.flatnonzero(tied)


def boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at a rank whose suffix shares fewer than ``length`` symbols with the suffix before it.

    ``jump`` is the step of backward extension: the rank of the suffix one symbol longer. When the
    interval of some common prefix splits at its value l, two neighbouring ranks with the same
    preceding symbol that fall into different parts jump to two ranks side by side whose common
    prefix is l + 1. Values are therefore met in increasing order. Only the smaller parts of a
    split are read, each for the neighbours on both sides.
    """
    n = len(order)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    jump = rank[order - 1]
    symbol = np.minimum(text[order - 1], 256).astype(np.int16)
    grouped = np.argsort(symbol, kind="stable")
    same = (symbol[grouped[1:]] == symbol[grouped[:-1]]) & (symbol[grouped[1:]] < 256)
    left = np.full(n, -1, dtype=np.int64)
    right = np.full(n, n, dtype=np.int64)
    left[grouped[1:][same]] = grouped[:-1][same]
    right[grouped[:-1][same]] = grouped[1:][same]
    found = np.zeros(n + 1, dtype=bool)
    found[[0, n]] = True
    first = text[order]
    level = 1 + np.flatnonzero((first[1:] != first[:-1]) | (first[1:] >= 256))
    for depth in range(length):
        if not len(level):
            break
        edges = np.flatnonzero(found)
        found[level] = True
        if depth == length - 1:
            break
        own = np.searchsorted(edges, level, side="right") - 1  # sorted, as the level is
        parents = own[np.concatenate(([True], own[1:] != own[:-1]))]
        starts = np.concatenate((edges[parents], level))
        merged = np.argsort(starts)
        starts, parent = starts[merged], np.concatenate((parents, own))[merged]
        low, high = edges[parent], edges[parent + 1]
        ends = np.minimum(np.append(starts[1:], n), high)
        sizes = ends - starts
        family = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        most = np.repeat(np.maximum.reduceat(sizes, family), np.diff(np.append(family, len(parent))))
        largest = np.flatnonzero(sizes == most)
        largest = largest[np.concatenate(([True], parent[largest][1:] != parent[largest][:-1]))]
        small = np.ones(len(starts), dtype=bool)
        small[largest] = False
        starts, ends, low, high, sizes = (x[small] for x in (starts, ends, low, high, sizes))
        part = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[part]
        back, ahead = left[at], right[at]
        here = at[(back >= low[part]) & (back < starts[part])]
        there = ahead[(ahead < high[part]) & (ahead >= ends[part])]
        level = jump[np.concatenate((here, there))]
        level = np.sort(level[~found[level]])
        level = level[np.concatenate(([True], level[1:] != level[:-1]))] if len(level) else level
    return found[:-1]


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For every context the starts of ``length``-byte strings that occur twice in the list."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.empty(int(sizes.sum()), dtype=np.int32)
    ends = np.cumsum(sizes) - 1
    body = np.ones(len(text), dtype=bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    text[ends] = 256 + np.arange(len(ends))
    order = suffix_order(text)
    shared = ~boundaries(text, order, length)
    shared[:-1] |= shared[1:]
    starts = np.sort(order[shared])
    begin = ends - sizes + 1
    cut = np.searchsorted(starts, begin)
    return [part - b for part, b in zip(np.split(starts, cut[1:]), begin)]


def _stretches(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """``(from, to)`` byte ranges covered by the windows at the sorted ``starts``."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    firsts = starts[np.concatenate(([0], breaks + 1))]
    lasts = starts[np.append(breaks, len(starts) - 1)]
    return list(zip(firsts.tolist(), (lasts + length).tolist()))


def _contexts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The bytes of one run per class, cut out of its document."""
    wanted = classes.groupBy("rep.row").agg(F.collect_list(F.struct(
        "anchor", "digest", "crowded", "n", F.col("rep.start").alias("start"), "bytes"
    )).alias("wanted"))  # the runs of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            rows, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, text, runs_wanted in zip(rows, byte_values(batch.column(1)), lists):
                for w in runs_wanted:
                    context = text[w["start"]: w["start"] + w["bytes"]]
                    out.append((w["anchor"], w["digest"], w["crowded"], w["n"], row, w["start"], context))
                    size += len(context)
                if size > 4 << 20:
                    yield _columns(out, CONTEXT)
                    out, size = [], 0
            if out:
                yield _columns(out, CONTEXT)

    return docs.join(wanted, "row").select("row", "text", "wanted").mapInArrow(
        cut, "anchor long, digest long, crowded boolean, n long, row long, start long, context binary"
    )


CONTEXT = pa.schema([
    ("anchor", pa.int64()), ("digest", pa.int64()), ("crowded", pa.bool_()), ("n", pa.int64()),
    ("row", pa.int64()), ("start", pa.int64()), ("context", pa.binary()),
])
SPAN = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """``(row, start, end)`` of repeats between different runs of the same anchor."""

    def solve(group: list[tuple]) -> pa.RecordBatch:
        out = []
        found = repeated_starts([context for *_, context in group], length)
        for (_, n, row, start, _), starts in zip(group, found):
            if n == 1:  # the others are repeats as a whole already
                out.extend((row, start + a, start + b) for a, b in _stretches(starts, length))
        return _columns(out, SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK and item[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(item)
                size += len(item[-1])
        if held:
            yield solve(held)

    chosen = contexts.select("anchor", "n", "row", "start", "context")
    return chosen.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "row long, start long, end long"
    )


def anchor_place(context: bytes, length: int, powers=None) -> int:
    """Where the anchor of a run's windows lies, counted from the run's first byte."""
    k = min(ANCHOR, length)
    first = np.frombuffer(context, np.uint8, length).astype(np.uint64)
    return int(np.argmin(_with_places(_grams(first, k, powers or _powers(length + 1)))))


NARROWED = pa.schema([
    ("group", pa.int64()), ("digest", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int64()),
    ("row", pa.int64()), ("start", pa.int64()), ("place", pa.int32()), ("context", pa.binary()),
])
NARROWED_SQL = (
    "group long, digest long, low int, high int, n long, row long, start long, place int, context binary"
)


def _halves(length: int):
    """Cuts each run in two by how far before the anchor its windows start, from ``low`` to ``high`` bytes.
    All windows of a half hold the same bytes around the anchor, longer ones than before: the half's group
    is a hash of them, so equal windows stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        powers = _powers(length + 1)
        for batch in batches:
            out, size = [], 0
            for group, low, high, n, row, start, place, context in zip(*(c.to_pylist() for c in batch.columns)):
                if place is None:
                    place = anchor_place(context, length, powers)
                middle = (low + high + 1) // 2
                for p, q in ((low, middle - 1), (middle, high)) if low < high else ((low, high),):
                    first, last = max(0, place - q), min(len(context) - length, place - p)
                    if first > last:
                        continue
                    part = context[first: last + length]
                    shared = context[place - p: place - q + length]
                    name = digest(shared, (group ^ (p * BASE)) & MASK)
                    out.append((
                        _long(name), _long(digest(part)), p, q, n, row, start + first, place - first, part
                    ))
                    size += len(part)
                if size > 4 << 20:
                    yield _columns(out, NARROWED)
                    out, size = [], 0
            if out:
                yield _columns(out, NARROWED)

    return run


def _long(value: int) -> int:
    """An unsigned 64-bit number as Spark holds it."""
    return value - (1 << 64) if value >> 63 else value


def _narrowed(contexts: DataFrame, length: int, crowd: int) -> DataFrame | None:
    """``(row, start, end)`` of repeats between the runs of crowded anchors.

    Each round halves the runs of what is still crowded. Halves that are equal as wholes are counted and go
    on as one; groups that are small enough now are compared; and after as many rounds as it takes to halve
    the windows of a run down to one nothing is left. A round makes at most two rows a run.
    """
    last = length - min(ANCHOR, length)
    now = contexts.where("crowded").select(
        F.col("anchor").alias("group"), F.lit(0).alias("low"), F.lit(last).alias("high"), "n", "row", "start",
        F.lit(None).cast("int").alias("place"), "context",
    )
    found = None
    while not now.isEmpty():
        halves = written(now.mapInArrow(_halves(length), NARROWED_SQL))
        classes = written(halves.groupBy("group", "digest").agg(
            F.sum("n").alias("times"), *[F.any_value(c).alias(c) for c in ("low", "high", "place", "context")],
            F.min("row").alias("row"), F.min("start").alias("start"),  # of the only one, if it is the only one
        ))
        equal = classes.where("times > 1").select("group", "digest")
        spans = halves.where("n = 1").join(equal, ["group", "digest"]).select(
            "row", "start", (F.col("start") + F.octet_length("context")).alias("end")
        )
        kinds = written(classes.where("low < high").groupBy("group").agg(
            F.count(F.lit(1)).alias("kinds"), F.min("times").alias("rarest")
        ).where("kinds > 1 AND rarest = 1").select("group", "kinds"))
        contested = classes.join(kinds, "group").withColumnRenamed("times", "n")
        few = contested.where(F.col("kinds") <= crowd)
        spans = spans.union(_compared(few.withColumnRenamed("group", "anchor"), length))
        found = spans if found is None else found.union(spans)
        now = written(contested.where(F.col("kinds") > crowd).select(
            "group", "low", "high", "n", "row", "start", "place", "context"
        ))
    return found


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """``(row, start, end)``: byte ranges of ``text`` covered by repeats; they may overlap.

    ``docs`` has ``row`` (unique long) and ``text``.
    """
    every = written(_runs_of(docs.select("row", "text"), length))
    # tables that hot anchors are joined with are written first: Spark then splits those anchors
    shared = written(
        every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    )
    runs_shared = written(every.join(shared, "anchor"))
    classes = written(runs_shared.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "windows")).alias("rep")
    ))
    # where every class occurs twice there is nothing to compare
    kinds = written(classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("n").alias("rarest")
    ).where("kinds > 1 AND rarest = 1").select("anchor", "kinds"))
    contested = classes.join(kinds, "anchor").select(
        "anchor", "digest", "n", "rep", (F.col("kinds") > crowd).alias("crowded"),
        (F.col("rep.windows") + (length - 1)).alias("bytes"),
    )
    contexts = written(_contexts(docs.select("row", "text"), contested))
    whole = classes.where("n > 1").select("anchor", "digest")
    copies = runs_shared.join(whole, ["anchor", "digest"]).select(
        "row", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end")
    )
    found = copies.union(_compared(contexts.where(~F.col("crowded")), length))
    narrowed = _narrowed(contexts, length, crowd)
    return found if narrowed is None else found.union(narrowed)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    crowd: int = CROWD,
) -> DataFrame:
    """``(key, n_bytes, kept, spans)`` per document: its text in UTF-8 without every byte covered by
    a ``length``-byte string that also starts elsewhere, and the maximal byte ranges removed.

    All strings are judged on the input; they never cross documents, and may overlap. A null text is
    empty; texts below ``length`` bytes stay whole. Repeated rows and rows with repeated or null keys
    are documents of their own, so both copies of a repeated row lose all their long strings. ``kept``
    is binary, as a cut may fall inside a character.
    """
    rows = _with_rows(docs, key, text)
    spans = repeated_spans(rows, length, crowd).groupBy("row").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")  # ranges of one document
    )
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, merged, sizes = [], [], []
            for value, found in zip(byte_values(batch.column(1)), batch.column(2).to_pylist()):
                ranges = _merged([(f["start"], f["end"]) for f in found or ()])
                pieces, at = [], 0
                for a, b in ranges:
                    pieces.append(value[at:a])
                    at = b
                pieces.append(value[at:])
                sizes.append(len(value))
                kept.append(b"".join(pieces))
                merged.append([{"start": a, "end": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], [key, "n_bytes", "kept", "spans"])

    return rows.join(spans, "row", "left").select("key", "text", "spans").mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, kept binary, "
        "spans array<struct<start:bigint,end:bigint>>"
    )


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges; neighbours that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _with_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(row, key, text)`` with a unique long ``row``: the key itself where it is one; otherwise
    numbers kept in a written table, so that every later scan sees the same ones."""
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    if chosen.schema["key"].dataType.simpleString() in ("bigint", "int"):
        counts = chosen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        if counts.where(F.col("key").isNull() | (F.col("n") > 1)).isEmpty():
            return chosen.withColumn("row", F.col("key").cast("long"))
    return written(chosen.withColumn("row", F.monotonically_increasing_id()))
