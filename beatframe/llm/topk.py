"""Exact top-k search by inner product with pivot-table elimination."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import stored, table
from beatframe.llm.products import LEAST, Best, exact, matrix, most_common_length, whole_numbers


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it (the first is the longest)."""
    if not len(sample):
        return sample
    chosen = [int(np.square(sample).sum(axis=1).argmax())]
    far = np.square(sample - sample[chosen[0]]).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.square(sample - sample[chosen[-1]]).sum(axis=1))
    return sample[chosen]


class Pivots:
    """The pivot table's side: distances to all pivots, and what they say about a vector.

    d(x, p)^2 = |x|^2 + |p|^2 - 2 x.p, so a vector's length and distances give its products with the pivots,
    and with them its place in the space the pivots span and how far it lies outside it. Two vectors are at
    least as far apart as their places and those distances are: the largest lower bound that pivots
    can give (no single |d(q,p) - d(c,p)| is above it). As 2 q.c = |q|^2 + |c|^2 - d(q,c)^2, it bounds the
    product from above by the product of the rows of places().
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float64)
        self.norms = np.square(self.pivots).sum(axis=1)
        values, vectors = np.linalg.eigh(self.pivots @ self.pivots.T)
        good = values > 1e-9 * max(values.max(initial=0.0), 1e-300)
        self.white = vectors[:, good] / np.sqrt(values[good])

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.square(x).sum(axis=1)[:, None] + self.norms[None] - 2 * x @ self.pivots.T, 0))

    def places(self, x: np.ndarray) -> np.ndarray:
        """Coordinates in the pivots' span and, last, the length of the rest, from lengths and distances alone."""
        size = np.square(x).sum(axis=1)
        y = (size[:, None] + self.norms[None] - np.square(self.distances(x))) / 2 @ self.white
        return np.concatenate([y, np.sqrt(np.maximum(size - np.square(y).sum(axis=1), 0))[:, None]], axis=1)


def box(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates of a block of candidates."""
    return places.min(axis=0), places.max(axis=0)


def scan(best: Best, q: np.ndarray, q_place: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_place: np.ndarray, c_ids: np.ndarray, c_row: np.ndarray, step: int = 16) -> tuple[int, int]:
    """Takes a block of candidates into best; returns how many bounds and how many products it evaluated.

    Queries whose k-th best score exceeds what the block's box of places allows skip the whole block. Every other
    query evaluates candidates in the order of their bounds, `step` at a time, until its k-th best score exceeds
    every bound that is left.
    """
    low, high = box(c_place)
    least = best.least.astype(np.float64)
    sizes = np.square(q_place).sum(axis=1)
    slack = 1e-9 * (1 + sizes + np.square(c_place).sum(axis=1).max())  # rounding
    # scores that end at 64 bits lie above their products, hence the second condition here and below
    some = np.flatnonzero((np.maximum(q_place * low, q_place * high).sum(axis=1) + slack >= least) | (least <= LEAST))
    bound = q_place[some] @ c_place.T + slack[some, None]
    qi, ci = np.nonzero((bound >= least[some, None]) | (least[some, None] <= LEAST))
    b = bound[qi, ci]
    qi = some[qi]
    other = q_row[qi] != c_row[ci]
    qi, ci, b = qi[other], ci[other], b[other]
    order = np.lexsort((-b, qi))
    qi, ci, b = qi[order], ci[order], b[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    done, evaluated = 0, 0
    while len(qi):
        now = np.flatnonzero(place < done + step)
        for a in range(0, len(now), 1 << 15):
            x, y = qi[now[a : a + (1 << 15)]], ci[now[a : a + (1 << 15)]]
            best.add(x, exact(q[x], c[y]), c_ids[y], c_row[y])
        evaluated += len(now)
        done += step
        left = (place >= done) & ((b >= best.least[qi]) | (best.least[qi] <= LEAST))
        qi, ci, b, place = qi[left], ci[left], b[left], place[left]
    return bound.size, evaluated


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, ids: str = "vec_id", vector: str = "embedding", scale: int = 256, pivots: int = 48, sample_rows: int = 4096, chunk_bytes: int = 64_000_000, tile: int = 512, counts: tuple | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k largest integer inner products with all other rows.

    Components become floor(scale * x). Pivots are spread rows of a bounded sample (sample_rows vectors of
    least hash). The pivot table is stored once: each vector with its place by the distances to all pivots, in the
    order of the nearest pivot and the distance to it, so that blocks of it are alike. Queries go to the tasks in chunks
    of chunk_bytes, one broadcast at a time, and every task scans its part of the table once for a chunk (see scan): no
    vector is copied for pairs. A query's first threshold is its k-th score in the sample, and
    a task's own k-th score after that; only each task's k best go on. counts: two accumulators, of bounds and of products.

    Left out: null ids, null vectors, vectors with null or non-finite components, and vectors of another
    length than the most common one. Rows that repeat an id are rows of their own: each is a query, and a
    candidate of the others; ties go to the smaller id. Scores beyond 64 bits are the nearest that fits. Fewer than k
    candidates: all of them. Columns of vectors can have any names. Empty table: no rows.
    """
    spark = vectors.sparkSession
    x = stored(whole_numbers(vectors, ids=ids, vector=vector, scale=scale))
    dim = most_common_length(x)
    x = x.filter(F.size("x") == dim)
    schema = "query_id bigint, q_row bigint, vec_id bigint, c_row bigint, score bigint"
    if not dim:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    found = x.orderBy(F.xxhash64("x"), "id", "row").limit(sample_rows).toArrow()
    sample, sample_ids, sample_rows_ = matrix(found["x"].combine_chunks(), dim), np.asarray(found["id"]), np.asarray(found["row"])
    table_ = Pivots(spread_pivots(sample.astype(np.float64), pivots))
    width = table_.places(sample[:1].astype(np.float64)).shape[1]

    def placed(batches):
        for b in batches:
            v = matrix(b["x"], dim).astype(np.float64)
            near = table_.distances(v)
            own = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * width, pa.array(table_.places(v).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, own, pa.array(near.argmin(axis=1)), pa.array(near.min(axis=1))], names=[*b.schema.names, "place", "nearest", "far"])

    held = "id bigint, x array<bigint>, row bigint, place array<double>"
    near = x.select("id", "x", "row").mapInArrow(placed, f"{held}, nearest bigint, far double")
    candidates = stored(near.repartitionByRange("nearest", "far", "row").sortWithinPartitions("nearest", "far", "row").select("id", "x", "row", "place"))

    def part_of(b) -> tuple[np.ndarray, ...]:
        return matrix(b["x"], dim), np.asarray(b["place"].flatten()).reshape(-1, width), np.asarray(b["id"]), np.asarray(b["row"])

    def seeds(batches):
        at = table_.places(sample.astype(np.float64))
        for b in batches:
            for a in range(0, b.num_rows, tile):
                part = b.slice(a, tile)
                q, place, _, row = part_of(part)
                best = Best(np.full(len(q), LEAST, dtype=np.int64), k)
                scan(best, q, place, row, sample, at, sample_ids, sample_rows_)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.least)], names=[*b.schema.names, "least"])

    size = max(1, chunk_bytes // (8 * (dim + width)))
    queries = stored(candidates.filter(F.col("id") % every == 0).mapInArrow(seeds, f"{held}, least bigint"))
    chunks = max(1, math.ceil(queries.count() / size))
    out = None
    for chunk in range(chunks):
        some = queries.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).orderBy("id", "row").toArrow().combine_chunks()
        if not len(some):
            continue
        shared = spark.sparkContext.broadcast((*part_of(some.to_batches()[0]), np.asarray(some["least"])))

        def search(batches, shared=shared):
            q, q_place, q_id, q_row, least = shared.value
            tiles = [(slice(a, a + tile), Best(least[a : a + tile], k)) for a in range(0, len(q), tile)]
            for b in batches:
                for a in range(0, b.num_rows, 4 * tile):
                    c, c_place, c_ids, c_row = part_of(b.slice(a, 4 * tile))
                    for at, best in tiles:
                        n = scan(best, q[at], q_place[at], q_row[at], c, c_place, c_ids, c_row)
                        for total, m in zip(counts or (), n, strict=False):
                            total.add(m)
            for at, best in tiles:
                i, score, ids_, rows = best.held()
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (q_id[at][i], q_row[at][i], ids_, rows, score)], names=["query_id", "q_row", "vec_id", "c_row", "score"])

        part = candidates.mapInArrow(search, schema)
        if chunks > 1:
            part = stored(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), "vec_id", "c_row"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """top_k over all embeddings; see there."""
    return top_k(table(spark, sf_dir, "embeddings"))
