"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a 23-bit
word of the perfect Golay code. A word gets the indices of the codewords to which it and its 23
neighbours decode: one index or six. Two words that differ in up to two bits share an index. If
two fingerprints differ in two bits at most, one of the segments has no error (pigeonhole) and the
next one has two at most; the key is the exact segment with one codeword index of the next.
Fingerprints that share a key are compared bit by bit.

Only distinct fingerprints are keyed, so copies cost nothing here. Keys shared by more than
``bucket`` distinct fingerprints are not paired: there every fingerprint is joined to its
own 65 points at distance 0 or 1, and fingerprints that share a point are linked to the smallest of
them. Two fingerprints are within two bits exactly if they share a point, so this is exact, and its
cost is linear.

Two bits of 64 are far less than edits of a few words change. ``similar`` therefore works on sets of
five-word shingles. Fingerprints within two bits, by the same Golay keys, propose pairs there as well. For pairs
further apart there are other keys: ``BANDS`` groups of ``ROWS`` least hashes each (MinHash): sets of
similarity J share a key with probability 1 - (1 - J^ROWS)^BANDS, whatever was edited and however
short the text is; at 0.8 one pair in 14,000 shares none. Prints of 256 bits over the shingles, whose
share of differing bits tells the similarity, only drop pairs that are far from it. The nodes that
proposed pairs connect are then brought together with their whole sets and compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, let_go_after, written
from .graph import components

SHINGLE = 3
BITS = 2
BUCKET = 64
WIDE_BUCKET = 4096
SETS = 1 << 24  # bytes of shingle sets in one comparison
SET_ROWS = 256
BROADCAST_BYTES = 8 << 20
BANDS = 24
ROWS = 5
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' hashes; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle, 0)
    places = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in places], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at: at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``(key, fingerprint, text_key)`` per document, the fingerprint as a signed long and
    ``text_key`` a hash of the whole text. A null text counts as empty: fingerprint zero."""
    chosen = docs.select(
        F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")
    ).select(key, "__text", F.xxhash64("__text").alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in byte_values(batch.column(1))]
            prints = pa.array(np.array(found, dtype="<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), prints, batch.column(2)], [key, "fingerprint", "text_key"]
            )

    kind = chosen.schema[key].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, fingerprint long, text_key long")


def _part_hashes(parts: set[bytes]) -> np.ndarray:
    """256 bits of hash for each part, one row of bytes a part."""
    one = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([one(p, SEED) + one(p, SEED + 1) for p in parts]), np.uint8).reshape(-1, 32)


def wide_print(parts: set[bytes]) -> bytes:
    """The 256 bits set in over half of the parts' hashes, as 32 bytes; zeros without parts."""
    return _wide_print(_part_hashes(parts))


def _wide_print(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(32)
    counts = np.zeros(256, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 12):
        bits = np.unpackbits(hashes[at: at + (1 << 12)], axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def _elements(hashes: np.ndarray) -> np.ndarray:
    """A set of shingles as sorted 64-bit numbers."""
    return np.unique(np.ascontiguousarray(hashes[:, :8]).view("<u8").ravel())


def _node(hashes: np.ndarray, elements: np.ndarray) -> bytes:
    """Print and digest of a set: 48 bytes, different for different sets."""
    return _wide_print(hashes) + xxhash.xxh3_128_digest(elements.tobytes(), SEED)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def least_hashes(elements: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of a set under each of ``BANDS * ROWS`` permutations."""
    out = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 1 << 11):
            part = elements[None, at: at + (1 << 11)] * factors[0] + factors[1]
            np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """``BANDS`` keys for each row of least hashes."""
    values = least.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            keys = (keys ^ values[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys


def shingles(words: list[bytes], size: int) -> set[bytes]:
    """Distinct runs of ``size`` words; a shorter text is one run."""
    return {b" ".join(words[i: i + size]) for i in range(max(len(words) - size, 0) + 1)} if words else set()


def wide_prints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``(key, text_key, fingerprint, size, keys)``: print and digest of the set of shingles in 48 bytes,
    its number of shingles, and its keys, none for a text without words."""
    chosen = docs.select(
        F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")
    ).select(key, "__text", F.xxhash64("__text").alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for batch in batches:
            found, sizes, least = [], [], []
            for value in byte_values(batch.column(1)):
                hashes = _part_hashes(shingles(value.lower().split(), shingle))
                elements = _elements(hashes)
                found.append(_node(hashes, elements))
                sizes.append(len(elements))
                least.append(least_hashes(elements, factors))
            keys = band_keys(np.array(least, np.uint64)).view("<i8")
            some = np.array(sizes, np.int64) > 0
            ends = np.concatenate(([0], np.cumsum(some) * BANDS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))],
                [key, "text_key", "fingerprint", "size", "keys"],
            )

    kind = chosen.schema[key].dataType.simpleString()
    return chosen.mapInArrow(
        let_go_after(run), f"`{key}` {kind}, text_key long, fingerprint binary, size int, keys array<long>"
    )


def most_bits(similarity: float) -> int:
    """The differing bits of 256 expected at a Jaccard similarity of sets of one size."""
    return int(256 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def proposed_bits(similarity: float) -> int:
    """Eight deviations above ``most_bits``: pairs of that similarity do not differ in more."""
    share = most_bits(similarity) / 256
    return int(256 * share + 8 * math.sqrt(256 * share * (1 - share)))


def _error_table() -> np.ndarray:
    """The error pattern of weight three at most for each of the 2,048 syndromes."""
    errors = np.zeros(1 << 11, dtype=np.uint32)
    patterns = [sum(1 << b for b in c) for n in range(1, 4) for c in combinations(range(23), n)]
    words = np.array(patterns, dtype=np.uint32)
    errors[_syndrome(words)] = words
    return errors


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = rest ^ (((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11)))
    return rest


def codeword_indices(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """For each 23-bit word the codeword indices of the word and its neighbours, one row a word;
    repeated indices are -1."""
    flips = np.array([0, *(1 << b for b in range(23))], dtype=np.uint32)
    near = words.astype(np.uint32)[:, None] ^ flips[None, :]
    found = np.sort(((near ^ errors[_syndrome(near)]) >> np.uint32(11)).astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _segment_keys(values: np.ndarray, errors: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(key, row)`` of 64-bit values: an exact segment and a codeword index of the next."""
    words = [(values >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in SEGMENTS]
    for i, exact in enumerate(words):
        codes = codeword_indices(words[(i + 1) % 3], errors)
        rows, places = np.nonzero(codes >= 0)
        yield ((first + i) << 40) | (exact[rows].astype(np.int64) << 12) | codes[rows, places], rows


def _keys(prints: DataFrame) -> DataFrame:
    """``(key, fingerprint)``: 3 to 18 keys for each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = _error_table()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
            for at in range(0, len(values), 1 << 14):
                part = values[at: at + (1 << 14)]
                for keys, rows in _segment_keys(part, errors, 0):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(part[rows].view("<i8"))], ["key", "fingerprint"]
                    )

    return prints.mapInArrow(run, "key long, fingerprint long")


def wide_links(nodes: DataFrame, bits: int, bucket: int = WIDE_BUCKET) -> DataFrame:
    """``(a, b)`` that connect the nodes which share a key and whose prints differ in ``bits`` of 256 at most.

    The nodes of a key are compared with each other in one task, which returns a spanning forest and
    not all pairs. A key of more than ``bucket`` nodes is cut into blocks, and every two of them are
    a task's work.
    """
    keyed = nodes.select(F.explode("keys").alias("key"), "fingerprint")
    crowded = written(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
    )
    usual = keyed
    found = None
    if not crowded.isEmpty():
        usual = keyed.join(crowded, "key", "left_anti")
        blocks = F.ceil(F.col("n") * 2 / bucket).cast("int")
        own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = keyed.join(crowded, "key").withColumn("blocks", blocks).withColumn("own", own).withColumn(
            "other", other
        )
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        found = _forest(dealt.select(pair.alias("key"), "fingerprint"), bits)
    usual = _forest(usual, bits)
    return (usual if found is None else usual.union(found)).distinct()


def _forest(keyed: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_keys, rest = np.zeros(0, np.int64), np.zeros((0, 6), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate((rest_keys, batch.column(0).to_numpy(zero_copy_only=False)))
            prints = np.concatenate((
                rest, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, 6)
            ))
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            yield from _linked(keys[:last], prints[:last], bits)
            rest_keys, rest = keys[last:], prints[last:]
        if len(rest_keys):
            yield from _linked(rest_keys, rest, bits)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(let_go_after(run), "a binary, b binary")


def _linked(keys: np.ndarray, prints: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The first four numbers of a row of ``prints`` are the print; the whole row names the node."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
    sizes = np.diff(np.append(starts, len(keys)))
    one, two = [], []
    pairs = np.asarray(starts)[sizes == 2]  # most of the keys that are shared at all
    near = np.bitwise_count(prints[pairs, :4] ^ prints[pairs + 1, :4]).sum(axis=1) <= bits
    one.append(pairs[near])
    two.append(pairs[near] + 1)
    for start, size in zip(np.asarray(starts)[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = prints[start: start + size, :4]
        waiting = np.arange(size)
        while len(waiting) > 1:  # one tree after the other, from the nodes that are not yet in one
            front, waiting = [int(waiting[0])], waiting[1:]
            while front and len(waiting):
                at = front.pop()
                near = np.bitwise_count(own[waiting] ^ own[at]).sum(axis=1) <= bits
                reached = waiting[near]
                waiting = waiting[~near]
                one.append(np.full(len(reached), start + at))
                two.append(start + reached)
                front.extend(reached.tolist())
    first, second = np.concatenate(one), np.concatenate(two)
    for at in range(0, len(first), 1 << 15):
        columns = [
            pa.array([row.tobytes() for row in prints[x[at: at + (1 << 15)]]], pa.binary())
            for x in (first, second)
        ]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def verified_links(
    docs: DataFrame, proposed: DataFrame, nodes: DataFrame, text: str, shingle: int, similarity: float,
    bucket: int = WIDE_BUCKET,
) -> DataFrame:
    """``(a, b)`` that connect the nodes with a Jaccard similarity of ``similarity`` or more, among all
    nodes that ``proposed`` connects.

    Each of these nodes sends the set of one of its texts once. What is connected is compared in one task,
    and beyond ``SETS`` bytes or four times ``bucket`` nodes in blocks, every two of them in a task.
    """
    members = written(
        components(proposed).withColumnRenamed("node", "fingerprint").join(nodes, "fingerprint")
        .select("root", "fingerprint", "text_key", "size")
    )
    weight = F.greatest(F.count(F.lit(1)) / (4 * bucket), F.sum(F.col("size").cast("long") * 8) / SETS)
    crowded = written(members.groupBy("root").agg(weight.alias("weight")).where("weight > 1"))
    blocks = F.coalesce(F.ceil(F.col("weight") * 2), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.join(F.broadcast(crowded), "root", "left").withColumn("blocks", blocks).withColumn(
        "own", own
    ).withColumn("other", other)
    group = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    wanted = written(dealt.groupBy("text_key").agg(F.collect_list(group).alias("groups")))
    chosen = wanted.withColumnRenamed("text_key", "__key")
    if (wanted.agg(F.sum(32 + 8 * F.size("groups"))).first()[0] or 0) <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")).withColumn(
        "text_key", F.xxhash64("__text")
    ).join(chosen, F.col("text_key") == F.col("__key")).select("__text", "text_key", "groups")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies of a text
        for batch in batches:
            held, many = [], 0
            for i, own_key in enumerate(batch.column(1).to_pylist()):
                if own_key in seen:
                    continue
                seen.add(own_key)
                value = byte_values(batch.column(0).slice(i, 1))[0]
                hashes = _part_hashes(shingles(value.lower().split(), shingle))
                elements = _elements(hashes)
                node, packed = _node(hashes, elements), elements.tobytes()
                for number in batch.column(2)[i].as_py():
                    held.append((number, node, packed))
                    many += len(packed)
                    if many > 1 << 23:
                        yield _set_batch(held)
                        held, many = [], 0
            if held:
                yield _set_batch(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, own = None, [], []
        for batch in (b.slice(at, SET_ROWS) for b in batches for at in range(0, b.num_rows, SET_ROWS)):
            for number, name, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    yield from _alike(names, own, similarity)
                    now, names, own = number, [], []
                if not names or names[-1] != name:
                    names.append(name)
                    own.append(np.frombuffer(packed, "<u8"))
        yield from _alike(names, own, similarity)

    sent = texts.mapInArrow(let_go_after(sets), "group long, fingerprint binary, elements binary")
    return sent.repartition("group").sortWithinPartitions("group", "fingerprint").mapInArrow(
        let_go_after(compare), "a binary, b binary"
    ).distinct()


def _set_batch(held: list) -> pa.RecordBatch:
    numbers, nodes, packed = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())],
        ["group", "fingerprint", "elements"],
    )


def _alike(names: list[bytes], sets: list[np.ndarray], similarity: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the sets with a Jaccard similarity of ``similarity`` or more."""
    if len(sets) < 2:
        return
    sizes = np.array([len(s) for s in sets])
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(places.astype(np.int32), np.cumsum(sizes)[:-1])
    mark = np.zeros(len(distinct), np.int32)
    one, two = [], []
    waiting = np.arange(len(sets))
    while len(waiting) > 1:
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            low, high = np.minimum(sizes[waiting], sizes[at]), np.maximum(sizes[waiting], sizes[at])
            fits = waiting[low >= similarity * high - 1e-9]
            if not len(fits):
                continue
            mark[places[at]] = 1
            starts = np.concatenate(([0], np.cumsum(sizes[fits])[:-1]))
            shared = np.add.reduceat(mark[np.concatenate([places[i] for i in fits])], starts)
            mark[places[at]] = 0
            near = shared >= similarity * (sizes[fits] + sizes[at] - shared) - 1e-9
            reached = fits[near]
            waiting = np.setdiff1d(waiting, reached, assume_unique=True)
            one += [names[at]] * len(reached)
            two += [names[i] for i in reached]
            front.extend(reached.tolist())
    if one:
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["a", "b"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` between distinct fingerprints that connect everything within two bits.

    All pairs of a key with up to ``bucket`` fingerprints; stars over shared points for the rest.
    """
    keyed = written(_keys(distinct))
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    small = keyed.join(sizes.where(F.col("n") <= bucket).select("key"), "key")
    one, two = small.toDF("key", "a"), small.toDF("key", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = keyed.join(sizes.where(F.col("n") > bucket).select("key"), "key")
    steps = F.array(F.lit(0).cast("long"), *[
        F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)
    ])
    points = crowded.select("fingerprint").distinct().select(
        "fingerprint", F.explode(steps).alias("step")
    ).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("step")).alias("point"))
    least = points.groupBy("point").agg(F.min("fingerprint").alias("a"), F.count(F.lit(1)).alias("n"))
    stars = points.join(least.where("n > 1"), "point").where(F.col("a") != F.col("fingerprint"))
    return pairs.union(stars.select("a", F.col("fingerprint").alias("b"))).distinct()


def golay_links(docs: DataFrame, prints: DataFrame, key: str, text: str) -> DataFrame:
    """``(a, b)`` that connect the nodes of ``prints`` whose texts' fingerprints, those of ``near_duplicates``, are
    equal or within two bits, found by Golay keys. A fingerprint stands for the smallest of its nodes."""
    coded = written(fingerprints(docs, key, text).select("text_key", F.col("fingerprint").alias("code")).distinct())
    nodes = prints.where("size > 0").select("text_key", "fingerprint").distinct()
    members = written(nodes.join(coded, "text_key").select("code", "fingerprint").distinct())
    least = written(members.groupBy("code").agg(F.min("fingerprint").alias("a")))
    equal = members.join(least, "code").where(F.col("a") != F.col("fingerprint"))
    linked = links(least.select(F.col("code").alias("fingerprint")))
    one, two = least.toDF("a", "x"), least.toDF("b", "y")
    near = linked.join(one, "a").join(two, "b").where(F.col("x") != F.col("y"))
    return equal.select("a", F.col("fingerprint").alias("b")).union(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(key, fingerprint, text_key, root, component)`` per document; ``component`` is the smallest
    key that links of two differing bits or fewer lead to, ``root`` the smallest such fingerprint.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like others.
    Repeated rows and repeated keys are documents of their own. A null key never becomes a
    component's name unless all its members have none; the component is null then.
    """
    prints = written(fingerprints(docs, key, text, shingle))
    distinct = written(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    return _named(prints, distinct, links(distinct.select("fingerprint"), bucket), key)


def similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
    similarity: float = 0.8, bucket: int = WIDE_BUCKET,
) -> DataFrame:
    """As ``near_duplicates``, with components of texts whose five-word shingles have a Jaccard
    similarity of ``similarity`` or more. Every link is checked on the whole sets. Equal texts are
    always together. Candidates are within two bits by Golay keys, or share a key of their least hashes; the
    README says how many pairs that finds.
    """
    prints = written(wide_prints(docs, key, text, shingle))
    nodes = written(prints.groupBy("fingerprint").agg(
        F.min(key).alias("least"), F.min("text_key").alias("text_key"), F.first("size").alias("size"),
        F.first("keys").alias("keys"),
    ))
    proposed = wide_links(nodes, proposed_bits(similarity), bucket).union(
        golay_links(docs, prints, key, text)
    ).distinct()
    found = verified_links(docs, proposed, nodes, text, shingle, similarity, bucket)
    return _named(prints, nodes.select("fingerprint", "least"), found, key)


def _named(prints: DataFrame, distinct: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    found = written(components(linked))
    rooted = distinct.join(
        found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    # written, so that Spark can split a component that holds much of the table
    names = written(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = rooted.join(names, "root").select("fingerprint", "root", "component")
    return prints.join(named, "fingerprint").select(
        key, "fingerprint", "text_key", "root", "component"
    )


def keep_one(
    docs: DataFrame, marked: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest key.

    ``marked`` is what ``near_duplicates`` or ``similar`` returns for ``docs``. Of several rows with that
    key the one with the smallest fingerprint and text hash stays, once. A component without any key
    keeps the row that is smallest by fingerprint and text hash. All columns return unchanged.
    """
    first = marked.where(F.col(key).eqNullSafe(F.col("component")))
    chosen = written(
        first.groupBy("root").agg(
            F.first("component").alias("__keep"), F.count(F.lit(1)).alias("n"),
            F.min(F.struct("fingerprint", "text_key")).alias("pick"),
        ).select("__keep", F.col("pick.text_key").alias("__text_key"), "n")
    )
    same = F.col(f"d.`{key}`").eqNullSafe(F.col("__keep")) & (
        F.xxhash64(F.coalesce(F.col(f"d.`{text}`"), F.lit(""))) == F.col("__text_key")
    )
    kept = docs.alias("d").join(chosen.drop("n"), same, "left_semi")
    if chosen.where("n > 1").isEmpty():
        return kept
    several = chosen.where("n > 1").select("__keep", "__text_key")
    once = kept.alias("d").join(several, same, "left_semi").dropDuplicates([key, text])
    return kept.alias("d").join(several, same, "left_anti").unionByName(once)
