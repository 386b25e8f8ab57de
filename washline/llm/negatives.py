"""Hard negatives by slots of scores.

An anchor's positives are its nearest rows of the same label. Each positive admits as negatives the nearest
rows of other labels whose score lies in a window below its own. The windows of an anchor overlap, but their
upper limits, in order, cut all scores into disjoint slots: everything up to the lowest limit, and what lies
between one limit and the next. A row falls into one slot, and a window is the part above its lower limit of
its own slot and all slots below. So every task keeps the best few rows a slot, the best of those over all
tasks are merged from the highest score down, and each window reads its answer off the tail that starts at
its slot: the few best of a union are among the few best of its parts.

Anchors are a stated share of the rows, so anchors and rows are dealt into blocks and every block of anchors
meets every block of rows once for the positives and once for the negatives. Blocks are dealt by row, not by
key or label, so copies and frequent labels spread; a pair of blocks returns a few rows an anchor and slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
BLOCK_ROWS = 4_096
BLOCK_BYTES = 16 << 20
ANCHORS_AT_ONCE = 256
LEAST_SCORE, MOST_SCORE = -(1 << 63), (1 << 63) - 1


def usable(vector: str) -> Column:
    """True for vectors, empty ones too, all of whose components are finite numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors, as 64-bit integers; what lies beyond them is cut off
    at their ends."""
    largest = (np.abs(anchors).max(initial=0) or 1) * (np.abs(rows).max(initial=0) or 1) * max(1, anchors.shape[1])
    if largest < 2.0 ** 53:  # every partial sum is a double
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in v] for v in m], dtype=object).reshape(m.shape) for m in (anchors, rows)]
    exact = whole[0] @ whole[1].T
    return np.clip(exact, LEAST_SCORE, MOST_SCORE).astype(np.int64)


def first_of(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller keys."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((keys[near], ~scores[near]))][:k]  # the complement turns the order of all 64 bits


def slot_of(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For ascending limits the first one not below each score; ``len(limits)`` above all of them."""
    return np.searchsorted(limits, scores, side="left")


# blocks

def _prepared(vectors: DataFrame, is_anchor: Column, key: str, vector: str, label: str) -> DataFrame:
    """``(row, id, label, dims, vector, asks, anchor_block, row_block, anchor_blocks, row_blocks)``, written."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = usable(vector) & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()
    rows = written(vectors.where(good).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"), F.size(v).alias("dims"), v.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ))
    most = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(64), F.floor(BLOCK_BYTES / (8 * F.col("dims") + 8))))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    grid = rows.groupBy("dims").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("n_asks")
    ).select("dims", blocks("n").alias("row_blocks"), blocks("n_asks").alias("anchor_blocks"))
    spread = F.xxhash64("row")
    return rows.join(grid, "dims").withColumns({
        "row_block": F.pmod(spread, F.col("row_blocks")).cast("int"),
        "anchor_block": F.pmod(spread, F.col("anchor_blocks")).cast("int"),
    })


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _met(anchors: DataFrame, rows: DataFrame):
    """Every block of anchors with every block of rows of the same length."""
    meet = ["dims", "anchor_block", "row_block"]
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own
    asked = anchors.withColumn("row_block", _every("row_blocks")).drop("row_blocks", "anchor_blocks")
    held = rows.drop("asks").withColumn("anchor_block", _every("anchor_blocks")).drop("row_blocks", "anchor_blocks")
    return asked.groupBy(meet).cogroup(held.groupBy(meet))


def _whole(block: pa.Table) -> np.ndarray:
    """The block's vectors as whole numbers: the floor of ``SCALE`` times each component."""
    flat = block["vector"].combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    return np.floor(SCALE * values).reshape(block.num_rows, -1) if block.num_rows else np.zeros((0, 0))


def _labels(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    names, codes = np.unique(
        np.array(anchors["label"].to_pylist() + rows["label"].to_pylist(), dtype=object), return_inverse=True
    )
    return codes[: anchors.num_rows], codes[anchors.num_rows:]


def _scored(anchors: pa.Table, rows: pa.Table):
    """``(anchor, its scores, where labels agree)``, for every anchor of the block."""
    a, r = _whole(anchors), _whole(rows)
    own, other = _labels(anchors, rows)
    for at in range(0, len(a), ANCHORS_AT_ONCE):
        scores = products(a[at: at + ANCHORS_AT_ONCE], r)
        for i in range(len(scores)):
            yield at + i, scores[i], other == own[at + i]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False).astype(np.int64)


def _best_positives(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive", pa.int64()),
                        ("positive_id", pa.int64()), ("score", pa.int64())])

    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        ids, places = _numbers(rows, "id"), _numbers(rows, "row")
        own, own_ids = _numbers(anchors, "row"), _numbers(anchors, "id")
        out = [[np.zeros(0, np.int64)] for _ in schema]
        for i, scores, same in _scored(anchors, rows):
            near = np.flatnonzero(same & (places != own[i]))
            near = near[first_of(scores[near], ids[near], k)]
            for column, values in zip(out, (
                np.full(len(near), own[i]), np.full(len(near), own_ids[i]), places[near], ids[near], scores[near]
            )):
                column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return best


def _best_of_slots(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int64()), ("negative", pa.int64()),
                        ("negative_id", pa.int64()), ("score", pa.int64())])

    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        ids, places = _numbers(rows, "id"), _numbers(rows, "row")
        own, limits = _numbers(anchors, "row"), anchors["limits"].to_pylist()
        least = _numbers(anchors, "least")
        out = [[np.zeros(0, np.int64)] for _ in schema]
        for i, scores, same in _scored(anchors, rows):
            cuts = np.array(limits[i], dtype=np.int64)
            near = np.flatnonzero(~same & (scores <= cuts[-1]) & (scores >= least[i]))
            slots = slot_of(scores[near], cuts)
            for s in np.unique(slots):
                part = near[slots == s]
                part = part[first_of(scores[part], ids[part], k)]
                for column, values in zip(out, (
                    np.full(len(part), own[i]), np.full(len(part), cuts[s]), places[part], ids[part], scores[part]
                )):
                    column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return best


def _percent(score: str, percent: int) -> Column:
    """An exact share of a 64-bit score."""
    return F.col(score).cast("decimal(20,0)") * F.lit(percent) / F.lit(100)


def mine(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for every row where
    ``is_anchor`` holds and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels whose score is at least ``low`` and at most ``high`` percent of the
    positive's. A score is the inner product of the components' floors of ``SCALE`` times their value; higher
    scores come first, ties by smaller key.

    Rows whose vector, label or key is null, or whose vector holds null or non-finite components, take no
    part. Vectors of different lengths have no score and do not meet; empty ones score 0. Rows that repeat a
    key are rows of their own, as anchors, positives and negatives. An anchor without positives, and a
    positive without negatives, gives no rows. Scores beyond 64 bits are cut off at their ends. Other columns
    are ignored, and an empty table gives an empty result.
    """
    rows = _prepared(vectors, is_anchor, key, vector, label)
    anchors = rows.where("asks").drop("asks")
    found = _met(anchors.drop("row_block"), rows.drop("anchor_block")).applyInArrow(
        _best_positives(positives), "anchor long, anchor_id long, positive long, positive_id long, score long"
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive")
    windows = written(
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).select(
            "anchor", "anchor_id", "positive", "positive_id", F.col("score").alias("positive_score"),
            F.floor(_percent("score", high)).cast("long").alias("upper"),
            F.ceil(_percent("score", low)).cast("long").alias("lower"),
        )
    )
    open_windows = windows.where(F.col("lower") <= F.col("upper"))
    limits = open_windows.groupBy("anchor").agg(
        F.array_sort(F.collect_set("upper")).alias("limits"), F.min("lower").alias("least")
    )
    asking = anchors.join(limits, F.col("row") == F.col("anchor")).drop("anchor")
    met = _met(asking.drop("row_block"), rows.drop("anchor_block")).applyInArrow(
        _best_of_slots(negatives), "anchor long, slot long, negative long, negative_id long, score long"
    )
    in_slot = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "negative_id", "negative")
    best = met.withColumn("place", F.row_number().over(in_slot)).where(F.col("place") <= negatives)
    # a few rows a slot and a few slots an anchor, from the highest score down
    merged = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        F.bitwise_not("score").alias("down"), "negative_id", "negative", "slot"
    ))).alias("tail"))
    in_window = F.slice(F.filter("tail", lambda x: (x["slot"] <= F.col("upper")) & (F.bitwise_not(x["down"]) >= F.col("lower"))), 1, negatives)
    return open_windows.join(merged, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(in_window).alias("at", "n")
    ).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.negative_id").alias("negative_id"), "positive_score", F.bitwise_not("n.down").alias("negative_score"),
    )
