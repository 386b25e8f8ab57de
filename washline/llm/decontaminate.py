"""Benchmark passages in documents, exact or lightly edited.

Texts are compared lower-cased (A-Z) with runs of white space as one space, in UTF-8. A passage of m
bytes may be changed in e = m * ``edits`` bytes, short ones in fewer (``budget``). By the q-gram lemma such an occurrence keeps at
least m - q + 1 - q * e of the passage's q-grams, on diagonals at most 2e apart.

A document is scanned for bytes at which any q-gram of any passage starts; stretches that hold too
few of them for any passage are left out. In the rest the shared q-grams of each passage are counted in
diagonal bands 4e wide, overlapping by half, and each band that meets the passage's number is verified by
a banded alignment of the whole passage.

The passages are sent to all executors as an index of bounded size; a larger benchmark is worked off in
shards, one scan of the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, let_go_after, written

GRAM = 8
EDITS = 0.07
KEPT = 16
FEWER = 0.7
LEAST = GRAM
SHARD_BYTES = 8 << 20
TABLE_BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(text: bytes) -> np.ndarray:
    """The eight bytes from every place as one number."""
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((n,), dtype="<u8", buffer=text, strides=(1,)).copy()


def budget(size: int, edits: float) -> int:
    """The edits allowed for a passage: so few that ``KEPT`` q-grams must survive, or, for a share ``FEWER`` of
    the edits, one at least."""
    many = min(int(size * edits), (size - GRAM + 1 - KEPT) // GRAM)
    return max(many, min(int(size * edits * FEWER), (size - GRAM) // GRAM), 0)


class Index:
    """The q-grams of a shard of passages, with the numbers that the filter needs."""

    def __init__(self, passages: list[tuple[int, bytes]], edits: float):
        self.ids = [i for i, _ in passages]
        self.texts = [t for _, t in passages]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.edits = np.array([budget(len(t), edits) for t in self.texts], dtype=np.int64)
        self.needed = self.sizes - GRAM + 1 - GRAM * self.edits
        codes = np.concatenate([grams(t) for t in self.texts])
        items = np.repeat(np.arange(len(self.texts)), self.sizes - GRAM + 1)
        places = np.concatenate([np.arange(n - GRAM + 1) for n in self.sizes])
        order = np.argsort(codes, kind="stable")
        codes, self.items, self.places = codes[order], items[order], places[order]
        self.codes, self.first, self.many = np.unique(codes, return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[_slot(self.codes)] = True
        # passages of like size share one test: as many hits as the least of them needs, in a
        # window as long as the places of the longest one's q-grams can spread
        self.tests: list[tuple[int, int]] = []
        spread = self.sizes - GRAM + 1 + self.edits
        ordered = np.argsort(self.sizes, kind="stable")
        while len(ordered):
            alike = self.sizes[ordered] <= 1.15 * self.sizes[ordered[0]]
            now, ordered = ordered[alike], ordered[~alike]
            self.tests.append((int(spread[now].max()), int(self.needed[now].min())))


def _slot(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes * MIX) >> np.uint64(64 - TABLE_BITS)


def occurrences(text: bytes, index: Index) -> list[tuple[int, int, int, int]]:
    """``(item number, start, end, edits)`` of every verified band, the best place of each."""
    codes = grams(text)
    if not len(codes):
        return []
    hit = index.table[_slot(codes)]
    counts = np.zeros(len(hit) + 1, dtype=np.int32)
    np.cumsum(hit, out=counts[1:])
    total, near = int(counts[-1]), None
    for w, needed in index.tests:
        if total < needed:
            continue
        w = min(w, len(hit))
        full = np.flatnonzero(counts[w:] - counts[:-w] >= needed)
        if len(full):
            if near is None:
                near = np.zeros(len(hit) + 1, dtype=np.int32)
            np.add.at(near, full, 1)
            np.add.at(near, full + w, -1)
    if near is None:
        return []
    at = np.flatnonzero(hit & (np.cumsum(near)[:-1] > 0))
    slot = np.searchsorted(index.codes, codes[at])
    slot = np.minimum(slot, len(index.codes) - 1)  # other codes share a place of the table
    true = index.codes[slot] == codes[at]
    at, slot = at[true], slot[true]
    found = []
    for part in np.array_split(np.arange(len(at)), max(1, int(index.many[slot].sum()) >> 22)):
        found.append(_pairs(at[part], slot[part], index))
    item, diagonal = (np.concatenate(x) for x in zip(*found))
    if not len(item):
        return []
    half = 2 * index.edits[item] + 1
    bands = np.concatenate((diagonal // (2 * half), (diagonal + half) // (2 * half)))
    key = np.stack((
        np.concatenate((item, item)), bands, np.repeat(np.array([0, 1]), len(item)),
    ))
    order = np.lexsort(key[::-1])
    key = key[:, order]
    head = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
    many = np.diff(np.append(head, key.shape[1]))
    enough = many >= index.needed[key[0, head]]
    out = set()
    for i, band, shifted in key[:, head[enough]].T.tolist():
        h = 2 * int(index.edits[i]) + 1
        low = band * 2 * h - (h if shifted else 0)
        best = exact(index.texts[i], text, low, low + 2 * h - 1)
        if best is None:
            best = align(index.texts[i], text, low, low + 2 * h - 1, int(index.edits[i]))
        if best is not None:
            out.add((i, *best))
    return sorted(out)


def _pairs(at: np.ndarray, slot: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    many = index.many[slot]
    begin = np.repeat(index.first[slot] - (np.cumsum(many) - many), many)
    entry = begin + np.arange(int(many.sum()))
    return index.items[entry], np.repeat(at, many) - index.places[entry]


def exact(passage: bytes, text: bytes, low: int, high: int) -> tuple[int, int, int] | None:
    """The first alignment without edits on the diagonals ``low .. high``, which no other one beats."""
    at = text.find(passage, max(low, 0), max(high, 0) + len(passage))
    return None if at < 0 else (at, at + len(passage), 0)


def align(
    passage: bytes, text: bytes, low: int, high: int, edits: int
) -> tuple[int, int, int] | None:
    """``(start, end, edits)`` of the best occurrence of the whole passage whose diagonals (place in the
    text less place in the passage) stay within ``edits`` of ``low .. high``; None beyond ``edits``.
    Ties go to the smaller end, then the later start."""
    low, high = low - edits, high + edits
    width = high - low + 1
    far = len(passage) + len(text) + 1
    steps = np.arange(width)
    cost = np.where((low + steps >= 0) & (low + steps <= len(text)), 0, far)
    start = low + steps
    source = np.frombuffer(text, dtype=np.uint8)
    for i, symbol in enumerate(passage):
        place = low + steps + i  # the text symbol that the diagonal step reads
        inside = (place >= 0) & (place < len(text))
        differs = np.ones(width, dtype=np.int64)
        differs[inside] = source[place[inside]] != symbol
        straight = np.where(inside, cost + differs, far)
        dropped = np.append(cost[1:], far) + 1  # a passage symbol missing in the text
        origin = np.append(start[1:], 0)
        new = np.where(dropped < straight, dropped, straight)
        new_start = np.where(dropped < straight, origin, start)
        # an extra text symbol moves one diagonal up at a cost of one
        lifted = new - steps
        least = np.minimum.accumulate(lifted)
        from_step = np.maximum.accumulate(np.where(lifted == least, steps, 0))
        cost = least + steps
        start = new_start[from_step]
        ends = low + steps + i + 1
        cost = np.where((ends >= 0) & (ends <= len(text)), cost, far)
    best = int(cost.min())
    if best > edits:
        return None
    j = int(np.argmin(cost))
    return max(int(start[j]), 0), int(low + j + len(passage)), best


def find_passages(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", edits: float = EDITS, least: int = LEAST,
) -> DataFrame:
    """``(row, key, item, start, end, edits)``: occurrences of whole passages, ``row`` a hash of the
    text, places in the normal form. Nearby alignments of one passage may overlap.

    Passages below ``least`` bytes in normal form (null and empty ones too) and those with a null id
    are left out; equal passages all report. A null text is empty. Repeated rows report each.
    """
    normalised = F.trim(F.regexp_replace(F.col(f"`{item_text}`"), r"[ \t-\r]+", " "))
    items = benchmark.select(
        F.col(f"`{item}`").cast("long").alias("item"), normalised.alias("text")
    ).where(F.col("item").isNotNull() & (F.octet_length("text") >= least)).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES)
    chosen = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).select(F.xxhash64("text").alias("row"), "key", "text")
    kind = chosen.schema["key"].dataType.simpleString()
    schema = f"row long, `{key}` {kind}, item long, start long, end long, edits long"
    result = None
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        passages = sorted((r["item"], normal(r["text"].encode())) for r in part.collect())
        passages = [(i, t) for i, t in passages if len(t) >= least]
        if not passages:
            continue
        found = chosen.mapInArrow(let_go_after(_scan(passages, key, edits)), schema)
        if shards > 1:  # the next shard takes this one's place in memory
            found = written(found)
        result = found if result is None else result.union(found)
    if result is None:
        result = docs.sparkSession.createDataFrame([], schema)
    return result


def _scan(passages: list[tuple[int, bytes]], key: str, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(passages, edits)
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(byte_values(batch.column(2))):
                for hit in occurrences(normal(value), index):
                    rows.append(i)
                    found.append((index.ids[hit[0]], *hit[1:]))
            taken = pa.array(rows, pa.int64())
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), *columns],
                ["row", key, "item", "start", "end", "edits"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``(key, n_items, item_ids, least_edits)`` of the documents that hold a passage; the ids of the
    passages as a sorted list joined by commas. Rows with equal key and text are one."""
    found = find_passages(docs, benchmark, key, **options)
    per_item = found.groupBy("row", key, "item").agg(F.min("edits").alias("edits"))
    return per_item.groupBy("row", key).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), ",").alias("item_ids"),
        F.min("edits").alias("least_edits"),
    ).drop("row")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The documents that hold no passage of the benchmark, all columns unchanged."""
    found = written(
        find_passages(docs, benchmark, key, text, **options)
        .select(F.col(key).alias("__key"), F.col("row").alias("__row")).distinct()
    )
    same = F.col(f"d.`{key}`").eqNullSafe(F.col("__key")) & (
        F.xxhash64(F.coalesce(F.col(f"d.`{text}`"), F.lit(""))) == F.col("__row")
    )
    return docs.alias("d").join(found, same, "left_anti")
