"""Rules for texts, and robust multivariate outliers among the texts that pass them.

``statistics`` counts what a whole text holds. ``judge`` turns the counts of a text into a vector of six
transformed statistics and rejects vectors far from the bulk of their language and source, measured by
the Mahalanobis distance under minimum-covariance-determinant (MCD) estimates.

MCD seeks the half of a group's vectors whose covariance has the smallest determinant. A concentration
step takes the estimates so far, orders the group by distance and estimates again from the nearest half.
Here a step is one scan: rows fall into shells of equal distance (``SHELLS`` an octave of its square),
counts and sums of products are added up a shell, and the shells that hold the nearest half, whole ones,
give the next estimates. So no group is sorted or gathered, whatever its size, and a group that holds a
third of all rows is added up in every task. Steps run from three deterministic starts side by side:
medians with no correlation, correlations of ``tanh``, and of spatial signs; the smallest determinant
stays. Texts within the 97.5 % radius of it are then weighed in for the last estimates, as is usual.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, written

LEAST_WORDS = 10
REPEATED_SHARE = 20  # percent of the words that may stand in repeated windows
WINDOW = 5
LEAST_GROUP = 100  # texts a group needs for estimates of its own
STEPS = 12
SETTLED = 1e-3  # change of the log determinant a group at which steps end
SHELLS = 32
LEAST_VARIANCE = 0.25
MEDIAN_STEP = 1 / 256
INNER = 0.975
OUTER = 0.9997
BROADCAST_GROUPS = 10_000
PIECE = 1 << 20

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?"
CAPITALS = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals"]

#: The statistics, each with the least spread it is taken to have. Rates are drawn to an ordinary value by a
#: few words' worth of it, so that short texts, whose rates vary by chance, do not stand out.
VECTOR = [
    ("word_length", 0.05), ("symbols", 0.5), ("dup_lines", 0.1), ("repeats", 0.05), ("marks", 0.1),
    ("capitals", 0.1),
]
SIZE = len(VECTOR)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
STARTS = ("coordinates", "tanh", "signs")


# counts of one text

def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many places stand in a window of ``width`` ids that the sequence holds twice or more."""
    if len(ids) <= width:
        return 0
    windows = ids.astype(np.int64)
    for step in range(1, width):  # the rank of a longer window from that of a shorter one and the next id
        joined = windows[:-1] * (int(ids.max()) + 1) + ids[step:]
        windows = np.unique(joined, return_inverse=True)[1].astype(np.int64)
    often = np.bincount(windows) > 1
    starts = np.flatnonzero(often[windows])
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _word_ids(text: bytes) -> np.ndarray:
    """A number for every word, equal for equal words; long texts are split a piece at a time."""
    if len(text) <= PIECE:
        pieces = [text]
    else:
        pieces, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end] not in SPACES:
                end += 1
            pieces.append(memoryview(text)[at:end])
            at = end
    known: dict[bytes, int] = {}
    ids = array("q")
    for piece in pieces:
        ids.extend(known.setdefault(w, len(known)) for w in bytes(piece).split())
    return np.frombuffer(ids, dtype=np.int64) if ids else np.zeros(0, dtype=np.int64)


def count(text: bytes) -> tuple[int, ...]:
    """The numbers named in ``COUNTS``. Bytes that are no UTF-8 count as they stand: every byte but a
    continuation is a code point."""
    ids = _word_ids(text)
    solid = text.translate(None, SPACES)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(ids), len(solid) - _continuations(solid), len(text) - len(text.translate(None, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeated_words(ids), len(text) - len(text.translate(None, MARKS)),
        len(text) - len(text.translate(None, CAPITALS)),
    )


def _continuations(data: bytes) -> int:
    codes = np.frombuffer(data, dtype=np.uint8)
    return int(((codes & 0xC0) == 0x80).sum())


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``(key, *groups, *COUNTS)``, one row a document; a null text is empty."""
    kept = list(dict.fromkeys([key, *groups]))
    chosen = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count(value) for value in byte_values(batch.column(len(kept)))]
            columns = zip(*counts) if counts else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *[pa.array(c, pa.int64()) for c in columns]], [*kept, *COUNTS]
            )

    return chosen.mapInArrow(run, f"{schema}, " + ", ".join(f"{c} long" for c in COUNTS))


# vectors

def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of ``VECTOR``."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log((chars + 100) / (words + 20)),
        F.asinh(100.0 * F.col("n_symbols") / (chars + 100)),
        F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
        F.col("n_repeat_words") / (words + 20.0),
        F.sqrt((F.col("n_marks") + 3) / (words + 20.0)),
        F.sqrt((F.col("n_capitals") + 3) / (chars + 100.0)),
    ]


# chi-square distribution

def chi2_below(x: float, dims: int) -> float:
    """Probability that a chi-square variable of ``dims`` degrees is at most ``x``."""
    a, half = dims / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi2_at(share: float, dims: int) -> float:
    """The value that a chi-square variable stays below with probability ``share``."""
    low, high = 0.0, 1.0
    while chi2_below(high, dims) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, dims) < share else (low, middle)
    return high


def consistency(share: float, dims: int = SIZE) -> float:
    """What the covariance of the nearest ``share`` of normal vectors is multiplied by."""
    return share / chi2_below(chi2_at(share, dims), dims + 2)


# estimates

def invert(moments: np.ndarray, factor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(means, inverses, log determinants)`` from rows of count, sums and sums of products; without
    ``factor`` of the correlations. No variance of a component is taken to be below 1, the unit of the
    vectors, and none in any direction below ``LEAST_VARIANCE``, as half of the texts may well agree."""
    n = moments[:, :1]
    means = moments[:, 1: 1 + SIZE] / n
    products = moments[:, 1 + SIZE:] / n
    cov = np.zeros((len(moments), SIZE, SIZE))
    for k, (i, j) in enumerate(PAIRS):
        cov[:, i, j] = cov[:, j, i] = products[:, k] - means[:, i] * means[:, j]
    if factor is None:
        scale = np.sqrt(np.maximum(cov.diagonal(axis1=1, axis2=2), 1e-12))
        cov /= scale[:, :, None] * scale[:, None, :]
    else:
        cov *= factor
    for i in range(SIZE):
        cov[:, i, i] = np.maximum(cov[:, i, i], 1)
    sizes, axes = np.linalg.eigh(cov)
    sizes = np.maximum(sizes, LEAST_VARIANCE)
    inverse = np.einsum("nik,nk,njk->nij", axes, 1 / sizes, axes)
    flat = np.stack([inverse[:, i, j] * (1 if i == j else 2) for i, j in PAIRS], axis=1)
    return means, flat, np.log(sizes).sum(axis=1)


def _estimates(moments: DataFrame, keys: list[str], factor: float | None) -> DataFrame:
    """``(*keys, mean, inverse, spread)`` from ``(*keys, moments array<double>)``."""
    kinds = ", ".join(f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.array(batch.column(len(keys)).to_pylist(), dtype=np.float64)
            means, flat, spread = invert(values, factor)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(list(means), pa.list_(pa.float64())),
                 pa.array(list(flat), pa.list_(pa.float64())), pa.array(spread)],
                [*keys, "mean", "inverse", "spread"],
            )

    return moments.select(*keys, "moments").mapInArrow(
        run, f"{kinds}, mean array<double>, inverse array<double>, spread double"
    )


def distance() -> Column:
    """The squared Mahalanobis distance of ``z`` under ``mean`` and ``inverse``."""
    step = [F.get("z", F.lit(i)) - F.get("mean", F.lit(i)) for i in range(SIZE)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + F.get("inverse", F.lit(k)) * step[i] * step[j]
    return F.greatest(total, F.lit(0.0))


def _products(v: list[Column]) -> list[Column]:
    """Aggregates that make up ``moments``: count, sums, and sums of products."""
    return [F.count(F.lit(1)).cast("double"), *[F.sum(x) for x in v], *[F.sum(v[i] * v[j]) for i, j in PAIRS]]


def _added(rows: DataFrame, keys: list[str], v: list[Column]) -> DataFrame:
    names = [f"m{i}" for i in range(1 + SIZE + len(PAIRS))]
    summed = rows.groupBy(*keys).agg(*[c.alias(n) for c, n in zip(_products(v), names)])
    return summed.select(*keys, F.array(*names).alias("moments"))


def _with(rows: DataFrame, params: DataFrame, many: int) -> DataFrame:
    """Rows with what is known of their group. A short list of groups is broadcast; a long one is joined by
    shuffle, where Spark splits groups that hold very many rows."""
    return rows.join(F.broadcast(params) if many <= BROADCAST_GROUPS else params, "g")


def _medians(rows: DataFrame, values: Column) -> DataFrame:
    """``(g, middle array)``: the lower median of each component of ``values`` a group, in steps of
    ``MEDIAN_STEP``. Equal steps are counted before the shuffle."""
    seen = rows.select("g", F.posexplode(values).alias("at", "v")).groupBy(
        "g", "at", F.round(F.col("v") / MEDIAN_STEP).cast("long").alias("step")
    ).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("g", "at")
    ranked = seen.withColumn("upto", F.sum("n").over(whole.orderBy("step"))).withColumn("all", F.sum("n").over(whole))
    middle = ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "at").agg(F.min("step").alias("step"))
    listed = middle.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "step"))).alias("steps"))
    return listed.select("g", F.transform("steps", lambda s: s["step"] * MEDIAN_STEP).alias("middle"))


def _grouped(rows: DataFrame, groups: tuple[str, ...], least: int) -> DataFrame:
    """``g`` for every row: its own group's name; the pool of small groups of its first column; the pool of
    all small ones. A group is small below ``least`` rows."""
    parts = [F.coalesce(F.hex(F.col(f"`{c}`").cast("string")), F.lit("-")) for c in groups]
    names = [F.concat_ws("/", F.lit(str(n)), *parts[:n]) for n in range(len(groups), -1, -1)]
    own = rows
    for level, name in enumerate(names):
        own = own.withColumn(f"g{level}", name)
    # one row a group; pools are made of the small groups' counts
    counts = own.groupBy(*[f"g{level}" for level in range(len(names))]).agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.withColumn("g", F.when(F.col("n") >= least, F.col("g0")))
    left = F.sum(F.when(F.col("g").isNull(), F.col("n")).otherwise(0))
    for level in range(1, len(names) - 1):
        pool = chosen.groupBy(f"g{level}").agg(left.alias("pool"))
        chosen = chosen.join(pool, f"g{level}").withColumn(
            "g", F.coalesce("g", F.when(F.col("pool") >= least, F.col(f"g{level}")))
        ).drop("pool")
    chosen = written(chosen)
    rest = chosen.agg(left).first()[0] or 0  # the pool of all
    return chosen.select("g0", F.coalesce("g", F.lit("0" if rest >= least else None)).alias("g"))


def fit(rows: DataFrame, least: int = LEAST_GROUP, steps: int = STEPS) -> DataFrame:
    """``(g, middle, scale, mean, inverse)`` a group from rows ``(g, v array<double>)`` that are written
    already: ``z = (v - middle) / scale`` has the mean and the inverse covariance given."""
    many = rows.agg(F.count_distinct("g")).first()[0]
    middle = written(_medians(rows, F.col("v")))
    off = lambda v, m: F.zip_with(v, m, lambda x, y: F.abs(x - y))
    spread = _medians(_with(rows, middle, many).select("g", off(F.col("v"), F.col("middle")).alias("v")), F.col("v"))
    floor = F.array(*[F.lit(s) for _, s in VECTOR])
    scale = F.zip_with(F.col("middle"), floor, lambda s, f: F.greatest(s * 1.4826, f))
    units = written(middle.join(spread.select("g", scale.alias("scale")), "g"))
    z = F.zip_with(F.zip_with(F.col("v"), F.col("middle"), lambda x, m: x - m), F.col("scale"), lambda d, s: d / s)
    scaled = written(_with(rows, units, many).select("g", z.alias("z")))

    part = [F.get("z", F.lit(i)) for i in range(SIZE)]
    length = F.sqrt(sum((x * x for x in part), F.lit(0.0)))
    # unit vectors and correlations stand for covariances; the middle is the centre of every start
    bent = {
        "coordinates": [F.lit(0.0)] * SIZE,
        "tanh": [F.tanh(x) for x in part],
        "signs": [F.when(length > 0, x / length).otherwise(0.0) for x in part],
    }
    begun = None
    for name in STARTS:
        moments = _added(scaled, ["g"], bent[name]).withColumn("start", F.lit(name))
        begun = moments if begun is None else begun.unionByName(moments)
    centred = F.transform("mean", lambda m: F.lit(0.0))
    params = written(_estimates(begun, ["g", "start"], None).withColumn("mean", centred))

    factor = consistency(0.5)
    total = None
    for _ in range(steps if many else 0):
        shell = F.floor(SHELLS * F.log2(F.greatest(distance(), F.lit(1e-9)))).cast("int")
        met = _with(scaled, params, many * len(STARTS)).withColumn("shell", shell)
        shells = _added(met, ["g", "start", "shell"], part)
        whole = Window.partitionBy("g", "start")
        n = F.get("moments", F.lit(0))
        nearest = shells.withColumn("before", F.sum(n).over(whole.orderBy("shell")) - n).withColumn(
            "all", F.sum(n).over(whole)
        ).where(2 * F.col("before") < F.col("all") + SIZE + 1)
        names = [F.sum(F.get("moments", F.lit(i))) for i in range(1 + SIZE + len(PAIRS))]
        half = nearest.groupBy("g", "start").agg(F.array(*names).alias("moments"))
        params = written(_estimates(half, ["g", "start"], factor))
        before, total = total, params.agg(F.sum("spread")).first()[0]
        if before is not None and abs(before - total) < SETTLED * many:
            break
    choice = F.min_by(F.struct("mean", "inverse"), F.struct("spread", "start")).alias("p")
    chosen = params.groupBy("g").agg(choice).select("g", "p.mean", "p.inverse")
    inner = _with(scaled, chosen, many).where(distance() <= chi2_at(INNER, SIZE))
    last = _estimates(_added(inner, ["g"], part), ["g"], consistency(INNER)).drop("spread")
    return written(units.join(last, "g"))


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source"),
    least: int = LEAST_GROUP, outer: float = OUTER,
) -> DataFrame:
    """``(key, *groups, *COUNTS, base_failed, distance, kept)``, one row a document.

    A text that fails the rules is not kept and takes no part in the estimates. The others are kept if
    their squared distance is at most what a normal vector stays below with probability ``outer``. Groups
    (a null is a value like any other) with fewer than ``least`` texts are judged together with the other
    small groups of the same first column, or of the whole table where these are too few; where even
    that is less than ``least`` the texts are kept and ``distance`` is null. A null or empty text has no
    words and fails. Repeated rows count each; columns besides the named ones are ignored, whatever they
    are called; an empty table gives an empty result.
    """
    counted = statistics(docs, key, text, groups)
    known = list(dict.fromkeys([key, *groups]))
    inner = [f"__{i}" for i in range(len(known))]  # the caller's names may clash with the ones used here
    rows = written(counted.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(known, inner)], *COUNTS, base_failed().alias("base_failed"),
        F.array(*vector()).alias("v"),
    ))
    own = tuple(inner[known.index(g)] for g in groups)
    fits = rows.where(~F.col("base_failed"))
    names = written(_grouped(fits, own, least))
    parts = [F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-")) for c in own]
    named = rows.withColumn("g0", F.when(~F.col("base_failed"), F.concat_ws("/", F.lit(str(len(own))), *parts)))
    many = names.count()
    placed = named.join(F.broadcast(names) if many <= BROADCAST_GROUPS else names, "g0", "left").drop("g0")
    vectors = written(placed.where(F.col("g").isNotNull()).select("g", "v"))
    params = fit(vectors, least)
    z = F.zip_with(F.zip_with(F.col("v"), F.col("middle"), lambda x, m: x - m), F.col("scale"), lambda d, s: d / s)
    joined = placed.join(F.broadcast(params) if many <= BROADCAST_GROUPS else params, "g", "left")
    measured = joined.withColumn("z", z).withColumn("distance", F.when(F.col("mean").isNotNull(), F.sqrt(distance())))
    limit = math.sqrt(chi2_at(outer, SIZE))
    return measured.select(
        *[F.col(i).alias(c) for c, i in zip(known, inner)], *COUNTS, "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"),
    )
