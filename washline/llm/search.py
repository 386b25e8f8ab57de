"""Ranked lexical search over bit-sliced Bloom signatures.

``build`` reads every text once. Documents of like size form a block whose Bloom filters are stored by
slices: slice ``b`` is a bitmap of the documents whose filter has bit ``b`` set, so the documents that may
hold a term are the ``and`` of a few slices. A term that occurs more often in a document is entered again
under each step of ``LADDER`` that its occurrences reach, so slices also bound occurrences from above. The
same scan counts, for the dictionary, the documents that hold each term.

``search`` sums, for each item and all documents of a block at once, the weighted slices of its terms: what
each document would score if it held all that its filter admits, never less than its score. The documents
with the highest such bounds are scored exactly, which gives a score that the k-th place reaches at least;
every document whose bound is not below it is then scored on its text, and the best of those remain. What is
left out is left out by proof: nothing depends on how many documents come near.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, written

#: Steps of occurrences and of sizes: 1, 2, 3, 4, 6, 8, 12, ... two an octave.
LADDER = np.array(sorted({1, *(2 << i for i in range(31)), *(3 << i for i in range(30))}), dtype=np.int64)
KEY_BITS = 12
HASHES = 4
BLOCK_BITS = 1 << 23
BLOCK_ROWS = 4_096
FLUSH_TERMS = 200_000
SHARD_BYTES = 4 << 20  # of items at a time
CHUNK_TERMS = 1_024
PROBES = 24  # documents an item whose exact scores set the limit
BROADCAST_BYTES = 8 << 20
UNIT = 1_000_000_000

#: A-Z become a-z, digits, letters and whatever is not ASCII stay, all else parts terms.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with all bits spread."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Filter keys of terms, by their hashes, at a step of ``LADDER``."""
    step = np.asarray(level, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(hashes + step)


def places(keys: np.ndarray, width: int) -> np.ndarray:
    """``(len(keys), HASHES)`` slices that a key sets."""
    first, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    turn = np.arange(HASHES, dtype=np.uint64)
    return ((first[:, None] + step[:, None] * turn) % np.uint64(width)).astype(np.int64)


# the index

class _Blocks:
    """Documents of one size waiting for their block."""

    def __init__(self, size: int):
        self.width = max(64, KEY_BITS * size)
        self.rows = max(8, min(BLOCK_ROWS, BLOCK_BITS // self.width // 8 * 8))
        self.ids: list = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []

    def packed(self) -> dict:
        n = len(self.ids)
        wide = -(-n // 8) * 8
        slices = np.zeros((self.width, wide // 8), dtype=np.uint8)
        for i, keys in enumerate(self.keys):
            slices[places(keys, self.width).ravel(), i // 8] |= np.uint8(128 >> i % 8)
        row = {"ids": self.ids, "lengths": self.lengths, "width": self.width, "slices": slices.tobytes()}
        self.ids, self.lengths, self.keys = [], [], []
        return row


def _scan(kind: pa.DataType):
    """A row is a block, or a part of the dictionary."""
    types = pa.schema([
        ("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("slices", pa.binary()),
        ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
    ])

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([values], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, _Blocks] = {}
        seen: Counter[bytes] = Counter()
        hashes: dict[bytes, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                words = terms(text)
                if not words:
                    continue
                often = Counter(words)
                seen.update(often.keys())
                own = [hashes.get(w) for w in often]
                for i, w in enumerate(often):
                    if own[i] is None:
                        own[i] = hashes[w] = xxhash.xxh64_intdigest(w)
                own = np.array(own, dtype=np.uint64)
                steps = np.searchsorted(LADDER, np.fromiter(often.values(), np.int64, len(often)), side="right")
                term = np.repeat(np.arange(len(own)), steps)
                level = np.arange(len(term)) - np.repeat(np.cumsum(steps) - steps, steps)
                keys = keys_of(own[term], level)
                size = int(LADDER[np.searchsorted(LADDER, len(keys))])
                block = waiting.setdefault(size, _Blocks(size))
                block.ids.append(key)
                block.lengths.append(len(words))
                block.keys.append(keys)
                if len(block.ids) >= block.rows:
                    yield row(**block.packed())
                if len(seen) >= FLUSH_TERMS:
                    yield row(terms=list(seen), counts=list(seen.values()))
                    seen.clear()
                    hashes.clear()
        for block in waiting.values():
            if block.ids:
                yield row(**block.packed())
        if seen:
            yield row(terms=list(seen), counts=list(seen.values()))

    return run


@dataclass
class Index:
    """``blocks``: ``(ids, lengths, width, slices)``; ``dictionary``: ``(term, df)``; documents with a term
    and their terms in all; the documents themselves as ``(key, text)``."""

    blocks: DataFrame
    dictionary: DataFrame
    documents: int
    terms: int
    source: DataFrame


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The signatures and the dictionary of all documents, whole texts. Documents without a term (null
    and empty texts among them) are in neither. Both are written once."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = source.schema["key"].dataType
    arrow = source.limit(0).toArrow().schema.field("key").type
    made = written(source.mapInArrow(
        _scan(arrow), f"ids array<{kind.simpleString()}>, lengths array<long>, width int, slices binary, "
        "terms array<binary>, counts array<long>",
    ))
    parts = made.where(F.col("terms").isNotNull()).select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    dictionary = written(parts.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df")))
    blocks = made.where(F.col("ids").isNotNull()).select("ids", "lengths", "width", "slices")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.agg(F.sum(F.size("ids")), F.sum(size)).first()
    return Index(blocks, dictionary, totals[0] or 0, totals[1] or 0, source)


# items

@dataclass
class Item:
    terms: list[bytes]
    weights: np.ndarray  # times the occurrences in the item


def weighted_items(items: DataFrame, index: Index, item: str, item_text: str) -> DataFrame:
    """``(item, number, terms, weights, size)`` of the distinct items that share a term with a document."""
    chosen = items.select(
        F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).cast("binary").alias("text")
    ).distinct().withColumn("number", F.sha2("text", 256))
    kind = chosen.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(t)) for t in byte_values(batch.column(1))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows),
                 pa.array([t for f in found for t in f], pa.binary()),
                 pa.array([n for f in found for n in f.values()], pa.int64())],
                ["item", "number", "term", "n"],
            )

    asked = chosen.mapInArrow(run, f"item {kind}, number string, term binary, n long")
    weight = F.floor(1000 * F.log((2 * F.lit(float(index.documents)) + 2) / (2 * F.col("df") + 1.0)))
    known = asked.join(index.dictionary, "term").withColumn("weight", F.col("n") * weight)
    listed = F.array_sort(F.collect_list(F.struct("term", "weight")))
    return known.groupBy("item", "number").agg(listed.alias("t")).select(
        "item", "number", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"),
        F.aggregate("t", F.lit(64).cast("long"), lambda a, x: a + F.octet_length(x["term"]) + 16).alias("size"),
    )


# bounds

def length_part(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - 75 + (75 * lengths * documents) // total


def share(occurrences: np.ndarray | int, part: np.ndarray | int):
    """What ``occurrences`` of a term add, a unit of weight, in a document of length part ``part``."""
    return (UNIT * occurrences) // (1000 * occurrences + 8 * part)


class Bounds:
    """Upper bounds of all items over a block."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.chunks = []
        at = 0
        while at < len(items):
            known: dict[bytes, int] = {}
            first = at
            while at < len(items) and (at == first or len(known) + len(items[at].terms) <= CHUNK_TERMS):
                for t in items[at].terms:
                    known.setdefault(t, len(known))
                at += 1
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in known], dtype=np.uint64)
            rows = [np.array([known[t] for t in x.terms], dtype=np.int64) for x in items[first:at]]
            self.chunks.append((first, hashes, rows))

    def of(self, width: int, slices: bytes, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(item, bound of every document)``; whole numbers below 2^53, held as floats."""
        n = len(parts)
        matrix = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
        for first, hashes, rows in self.chunks:
            added = np.zeros((len(hashes), n))
            alive = np.arange(len(hashes))
            bits, before = None, 0
            for level in range(len(LADDER)):
                at = places(keys_of(hashes[alive], level), width)
                own = np.bitwise_and.reduce(matrix[at], axis=1)
                bits = own if bits is None else own & bits
                held = bits.any(axis=1)
                alive, bits = alive[held], bits[held]
                if not len(alive):
                    break
                last = level + 1 == len(LADDER)
                now = UNIT // 1000 if last else share(int(LADDER[level + 1]) - 1, parts)
                added[alive] += np.unpackbits(bits, axis=1, count=n) * (now - before)
                before = now
            for i, own in enumerate(rows):
                yield first + i, self.items[first + i].weights @ added[own]


def _blocks_of(batch: pa.RecordBatch, documents: int, total: int):
    for i in range(batch.num_rows):
        lengths = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
        yield batch.column(0)[i].values, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), length_part(
            lengths, documents, total
        )


def _highest(items: list[Item], index_size: tuple[int, int], probes: int):
    """``(item, key, bound)``: a task's highest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(items)
        best: list[np.ndarray] = [np.zeros(0)] * len(items)
        keys: list[list] = [[] for _ in items]
        for batch in batches:
            for ids, width, slices, parts in _blocks_of(batch, *index_size):
                for item, bound in bounds.of(width, slices, parts):
                    least = best[item][-1] if len(best[item]) >= probes else 0.0
                    over = np.flatnonzero(bound > least)
                    if not len(over):
                        continue
                    if len(over) > probes:
                        over = over[np.argpartition(-bound[over], probes - 1)[:probes]]
                    every = np.concatenate((best[item], bound[over]))
                    names = keys[item] + ids.take(pa.array(over)).to_pylist()
                    order = np.argsort(-every, kind="stable")[:probes]
                    best[item], keys[item] = every[order], [names[j] for j in order]
        counts = [len(b) for b in best]
        if sum(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(items)), counts), pa.int32()),
                 pa.array([k for own in keys for k in own], ids.type),
                 pa.array(np.concatenate(best).astype(np.int64))], ["item", "key", "bound"],
            )

    return run


def _not_excluded(items: list[Item], index_size: tuple[int, int], limits: list[int]):
    """``(item, key)`` of every document whose bound reaches the item's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(items)
        for batch in batches:
            for ids, width, slices, parts in _blocks_of(batch, *index_size):
                for item, bound in bounds.of(width, slices, parts):
                    over = np.flatnonzero(bound >= limits[item])
                    if len(over):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(over), item, np.int32)), ids.take(pa.array(over))], ["item", "key"]
                        )

    return run


# exact scores

def _scores(items: list[Item], index_size: tuple[int, int]):
    """``(item, key, score)`` from ``(key, text, items)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, scores = [], [], []
            for i, (text, wanted) in enumerate(zip(byte_values(batch.column(1)), batch.column(2).to_pylist())):
                words = terms(text)
                if not words:
                    continue
                often = Counter(words)
                part = int(length_part(len(words), *index_size))
                for item in wanted:
                    own = items[item]
                    score = sum(
                        int(w) * share(often[t], part) for t, w in zip(own.terms, own.weights) if t in often
                    )
                    if score > 0:
                        rows.append(i)
                        numbers.append(item)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), batch.column(0).take(pa.array(rows, pa.int64())),
                 pa.array(scores, pa.int64())], ["item", "key", "score"],
            )

    return run


def _rescored(index: Index, pairs: DataFrame, items: list[Item]) -> DataFrame:
    """``(item, key, score)`` of the documents in ``pairs``; every row of a repeated key is scored."""
    wanted = written(pairs.groupBy("key").agg(F.collect_set("item").alias("items")).withColumnRenamed("key", "k"))
    named = F.coalesce(F.octet_length(F.col("k").cast("string")), F.lit(0))
    held = wanted.agg(F.sum(48 + named + 8 * F.size("items"))).first()[0] or 0
    side = F.broadcast(wanted) if held <= BROADCAST_BYTES else wanted
    texts = index.source.join(side, F.col("key").eqNullSafe(F.col("k"))).select("key", "text", "items")
    kind = index.source.schema["key"].dataType.simpleString()
    return texts.mapInArrow(
        _scores(items, (index.documents, index.terms)), f"item int, key {kind}, score long"
    )


def _first(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", probes: int = PROBES,
) -> DataFrame:
    """``(item, rank, key, score)``, named as the columns given: the ``k`` best documents of each item
    with a score above 0, ties to the smaller key.

    A null text has no terms, and an item without a known term no answers. Equal rows of ``items`` are one
    item; items that differ in text under one id, and items whose id is null, answer each. Rows that repeat
    a key are documents of their own, and a null key is one that comes first on ties. Other columns are
    ignored, and an empty table on either side gives an empty result.
    """
    index = build(docs, key, text)
    spark = docs.sparkSession
    kinds = [items.schema[item].dataType.simpleString(), index.source.schema["key"].dataType.simpleString()]
    schema = f"`{item}` {kinds[0]}, rank int, `{key}` {kinds[1]}, score long"
    result = None
    if index.documents:
        asked = written(weighted_items(items, index, item, item_text))
        shards = -(-(asked.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES)
        for shard in range(shards):
            found = _search_shard(index, asked.where(F.pmod(F.xxhash64("item", "number"), F.lit(shards)) == shard), k, probes)
            result = found if result is None or found is None else result.union(found)
    if result is None:
        return spark.createDataFrame([], schema)
    return result.select(
        F.col("id").alias(item), "rank", F.col("key").alias(key), "score"
    )


def _search_shard(index: Index, asked: DataFrame, k: int, probes: int) -> DataFrame | None:
    rows = asked.select("item", "number", "terms", "weights").orderBy("item", "number").collect()
    if not rows:
        return None
    items = [Item([bytes(t) for t in r["terms"]], np.array(r["weights"], dtype=np.float64)) for r in rows]
    size = (index.documents, index.terms)
    kind = index.source.schema["key"].dataType.simpleString()
    high = index.blocks.mapInArrow(
        _highest(items, size, max(k, probes)), f"item int, key {kind}, bound long"
    )
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))
    tried = high.withColumn("place", place).where(F.col("place") <= max(k, probes)).select("item", "key")
    reached = _first(_rescored(index, tried, items), k).where(F.col("rank") == k)
    limits = [1] * len(items)
    for r in reached.select("item", "score").collect():
        limits[r["item"]] = r["score"]
    left = index.blocks.mapInArrow(_not_excluded(items, size, limits), f"item int, key {kind}")
    best = _first(_rescored(index, left, items), k)
    spark = asked.sparkSession
    names = spark.createDataFrame(
        [(i, r["item"]) for i, r in enumerate(rows)], f"item int, id {asked.schema['item'].dataType.simpleString()}"
    )
    return best.join(F.broadcast(names), "item").select("id", "rank", "key", "score")
