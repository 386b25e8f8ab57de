"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means that charges full clusters, so that lists are of like
length. They are searched through a graph in memory: from a few entry points, each step visits the
neighbours of the best centroid not yet expanded, for a whole batch of vectors at once. Every vector goes
to the list of its nearest centroid and, near a boundary, also to others: those whose distance is within
``closure`` of the nearest, unless a list chosen before is close by: less than half the vector's distance
from them. A query
reads the lists whose centroid is within ``ratio`` of its nearest one's distance; the ratio is set on the
sample.

Lists are cut into blocks of rows, so a list that holds very many vectors is many tasks' work. Queries meet
the blocks of their lists; a block returns its best for each query, and the best of those remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE = 16_384
LIST_ROWS = 256
MOST_LISTS = 2_048
LINKS = 16
BEAM = 64
CLOSURE = 1.02
REPLICAS = 4
APART = 0.5
WANTED = 0.98
QUERIES = 256
BLOCK_ROWS = 4_096
ROUNDS = 12


def usable(df: DataFrame, vector: str) -> Column:
    """True for vectors of finite components that are not all zero."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """k-means whose assignment adds a charge for clusters above the mean size."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(distinct)))
    centers = distinct[rng.choice(len(distinct), lists, replace=False)].astype(np.float64)
    mean = len(sample) / lists
    charge = np.zeros(lists)
    for _ in range(ROUNDS):
        scale = float(np.median(squared(sample[:2048], centers).min(axis=1))) or 1.0
        own = np.concatenate([
            np.argmin(squared(sample[i: i + 2048], centers) + charge * scale, axis=1)
            for i in range(0, len(sample), 2048)
        ])
        sizes = np.bincount(own, minlength=lists)
        charge = np.clip(charge + 0.1 * (sizes / mean - 1), 0, 1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        full = sizes > 0
        centers[full] = sums[full] / sizes[full, None]
    return np.unique(centers, axis=0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    far = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return np.maximum(far, 0)


class Graph:
    """Centroids with links to the nearest ones, and to a few others that join far regions."""

    def __init__(self, centers: np.ndarray, links: int = LINKS, seed: int = 7):
        self.centers = centers
        k = len(centers)
        near = min(links, k - 1)
        far = squared(centers, centers)
        np.fill_diagonal(far, np.inf)
        nearest = np.argsort(far, axis=1, kind="stable")[:, :near]
        ring = np.random.default_rng(seed).permutation(k)
        follow = np.empty((k, 2), dtype=np.int64)  # a ring through all of them keeps the graph whole
        follow[ring, 0], follow[ring, 1] = np.roll(ring, 1), np.roll(ring, -1)
        self.links = np.concatenate((nearest, follow), axis=1)
        self.entries = ring[: min(8, k)]
        self.usual = 0.0  # the usual distance to the nearest centroid, once calibrated

    def search(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """``(centroids, distances)``, nearest first; -1 and infinity where fewer were met."""
        n, k = len(vectors), len(self.centers)
        beam = min(beam, k)
        rows = np.arange(n)
        seen = np.zeros((n, k), dtype=bool)
        best = np.full((n, beam), -1, dtype=np.int64)
        cost = np.full((n, beam), np.inf)
        done = np.ones((n, beam), dtype=bool)
        fresh = np.tile(self.entries, (n, 1))
        while len(rows):
            known = seen[rows[:, None], fresh]
            seen[rows[:, None], fresh] = True
            step = self.centers[fresh] - vectors[rows][:, None, :]
            far = np.sqrt(np.einsum("ijk,ijk->ij", step, step))
            # a link met twice in one step counts once
            order = np.argsort(fresh, axis=1, kind="stable")
            sorted_links = np.take_along_axis(fresh, order, axis=1)
            twice = np.zeros_like(known)
            np.put_along_axis(
                twice, order,
                np.concatenate((np.zeros((len(rows), 1), bool), sorted_links[:, 1:] == sorted_links[:, :-1]), axis=1),
                axis=1,
            )
            far[known | twice] = np.inf
            all_cost = np.concatenate((cost[rows], far), axis=1)
            all_best = np.concatenate((best[rows], fresh), axis=1)
            all_done = np.concatenate((done[rows], np.zeros_like(known)), axis=1)
            keep = np.argsort(all_cost, axis=1, kind="stable")[:, :beam]
            cost[rows] = np.take_along_axis(all_cost, keep, axis=1)
            best[rows] = np.take_along_axis(all_best, keep, axis=1)
            done[rows] = np.take_along_axis(all_done, keep, axis=1) | np.isinf(cost[rows])
            open_ones = ~done[rows]
            more = open_ones.any(axis=1)
            rows = rows[more]
            pick = np.argmax(open_ones[more], axis=1)  # the nearest that is not expanded
            done[rows, pick] = True
            fresh = self.links[best[rows, pick]]
        best[np.isinf(cost)] = -1
        return best, cost

    def lists_of(self, vector_rows: np.ndarray, closure: float, replicas: int) -> list[np.ndarray]:
        """The lists that hold each vector."""
        best, cost = self.search(vector_rows, min(BEAM, max(4 * replicas, 16)))
        out = []
        for found, far in zip(best, cost):
            chosen = [found[0]]
            for c, d in zip(found[1:], far[1:]):
                if c < 0 or len(chosen) == replicas or d > closure * far[0]:
                    break
                gap = self.centers[chosen] - self.centers[c]
                if (np.sqrt((gap * gap).sum(axis=1)) >= APART * d).all():
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    def lists_for(
        self, queries: np.ndarray, ratio: float, sizes: np.ndarray, least: int
    ) -> list[np.ndarray]:
        """The lists that each query reads: by distance ratio, and on until ``least`` rows are in reach.
        The beam is widened for the queries whose last centroid is still within the ratio."""
        k, out = len(self.centers), [np.zeros(0, np.int64)] * len(queries)
        open_ones, beam = np.arange(len(queries)), BEAM
        while len(open_ones):
            best, cost = self.search(queries[open_ones], beam)
            again = []
            for row, found, far in zip(open_ones.tolist(), best, cost):
                met = found >= 0
                found, far = found[met], far[met]
                reach = np.cumsum(sizes[found]) - sizes[found]
                take = (far <= ratio * max(far[0], self.usual)) | (reach < least)
                if take.all() and beam < k:
                    again.append(row)
                else:
                    out[row] = found[take]
            open_ones, beam = np.array(again, dtype=np.int64), 2 * beam
        return out

    def calibrated(self, sample: np.ndarray, k: int, closure: float, replicas: int, wanted: float) -> float:
        """The distance ratio within which ``wanted`` of the neighbours inside the sample are found, from
        some queries of it. Neighbours in the whole table are nearer, so it finds more of them."""
        queries = sample[:QUERIES]
        far = squared(queries, sample)
        far[np.arange(len(queries)), np.arange(len(queries))] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        rows = np.unique(near)
        lists = dict(zip(rows.tolist(), self.lists_of(sample[rows], closure, replicas)))
        gaps = np.sqrt(squared(queries, self.centers))
        # a query on top of a centroid, one of many copies perhaps, has no distance to compare with
        self.usual = float(np.median(gaps.min(axis=1))) or 1e-300
        ratios = [
            gaps[q, lists[r]].min() / max(gaps[q].min(), self.usual)
            for q, found in enumerate(near.tolist()) for r in found
        ]
        return float(np.quantile(ratios, wanted, method="higher")) if ratios else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _assigned(vectors: DataFrame, graph: Graph, choose) -> DataFrame:
    """``(list, id, row, vector)``: a row for each list that ``choose`` gives a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = choose(graph, _matrix(part.column(2)))
                rows = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists).astype(np.int32)), *[c.take(rows) for c in part.columns]],
                    ["list", "id", "row", "vector"],
                )

    return vectors.mapInArrow(run, "list int, id long, row long, vector array<double>")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    list_rows: int = LIST_ROWS, ratio: float | None = None, wanted: float = WANTED,
    closure: float = CLOSURE, replicas: int = REPLICAS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row where ``is_query`` holds its ``k`` nearest
    other rows found, by Euclidean distance in double precision, ties to the smaller id. Without
    ``ratio`` it is set on the sample so that a share ``wanted`` of its neighbours is found.

    Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do
    those of another length than the most frequent one (the larger on ties), nor rows without id. Rows
    that repeat an id are rows of their own: each asks, and each is a candidate of all others.
    """
    v = F.col(f"`{vector}`")
    clean = vectors.where(usable(vectors, vector) & F.col(f"`{key}`").isNotNull())
    lengths = clean.groupBy(F.size(v).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # written, so that a row keeps its number
    chosen = written(clean.where(F.size(v) == common["n"]).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
        v.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    ))
    rows = chosen.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in rows], dtype=np.float64)
    lists = min(MOST_LISTS, max(1, common["rows"] // list_rows), max(1, len(sample) // 8))
    graph = Graph(fit_centroids(sample, lists))
    if ratio is None:
        ratio = graph.calibrated(sample, k, closure, replicas, wanted)

    held = written(_assigned(
        chosen.drop("asks"), graph, lambda g, m: g.lists_of(m, closure, replicas)
    ))
    sizes = _sizes(held, len(graph.centers))
    least = (k + 1) * replicas
    asked = written(_assigned(
        chosen.where("asks").drop("asks"), graph,
        lambda g, m: g.lists_for(m, ratio, sizes, least),
    ))
    # every block of a list's rows meets every block of the queries that read the list
    rows_of, queries_of = _blocks(sizes), _blocks(_sizes(asked, len(graph.centers)))
    meet = ["list", "block", "part"]
    queries = _dealt(asked, "part", queries_of).withColumn("block", _every(rows_of))
    dealt = _dealt(held, "block", rows_of).withColumn("part", _every(queries_of))
    found = queries.groupBy(meet).cogroup(dealt.groupBy(meet)).applyInPandas(
        _best_of_block(k), "query_id long, query_row long, vec_id long, row long, score double"
    )
    once = found.groupBy("query_id", "query_row", "vec_id", "row").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _sizes(assigned: DataFrame, lists: int) -> np.ndarray:
    """Rows of each list: one number a list reaches the driver."""
    counts = assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = np.zeros(lists, dtype=np.int64)
    for r in counts:
        sizes[r["list"]] = r["n"]
    return sizes


def _blocks(sizes: np.ndarray) -> Column:
    """The number of blocks of a row's list."""
    many = np.maximum(1, -(-sizes // BLOCK_ROWS))
    return F.get(F.array(*[F.lit(int(n)) for n in many]), F.col("list"))


def _dealt(assigned: DataFrame, name: str, blocks: Column) -> DataFrame:
    return assigned.withColumn(name, F.pmod(F.xxhash64("row"), blocks).cast("int"))


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def _best_of_block(k: int):
    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, places = rows["id"].to_numpy(), rows["row"].to_numpy()
            matrix = np.stack(rows["vector"].to_numpy())
            for query, own, vector in zip(queries["id"].to_numpy(), queries["row"].to_numpy(), queries["vector"]):
                step = matrix - vector
                far = np.sqrt(np.einsum("ij,ij->i", step, step))
                far[places == own] = np.inf
                order = np.lexsort((places, ids, far))[:k]  # a block holds a row once
                order = order[np.isfinite(far[order])]
                out.append(pd.DataFrame({
                    "query_id": query, "query_row": own, "vec_id": ids[order], "row": places[order], "score": far[order],
                }))
        if not out:
            names = {"query_id": "int64", "query_row": "int64", "vec_id": "int64", "row": "int64", "score": "float64"}
            return pd.DataFrame({n: [] for n in names}).astype(names)
        return pd.concat(out, ignore_index=True)

    return best
