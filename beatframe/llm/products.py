"""Exact integer inner products of vectors of whole numbers, and the k best of many."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = (1 << 63) - 1
LEAST = -MOST - 1  # below every score


def whole_numbers(vectors: DataFrame, *, ids: str, vector: str, scale: int, also: dict | None = None) -> DataFrame:
    """id, x (floor(scale * component), bigint), row (a number of its own) and the columns of also.

    Left out: null ids, null vectors, and vectors with null or non-finite components. A component beyond 64
    bits becomes the largest or smallest number of 64 bits.
    """
    x = vectors.select(F.col(ids).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), *[c.alias(n) for n, c in (also or {}).items()])
    x = x.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return x.select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x"), F.monotonically_increasing_id().alias("row"), *(also or {}))


def most_common_length(x: DataFrame) -> int:
    """Of column x; the smaller on ties, 0 where there is none."""
    return next((r["n"] for r in x.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()), 0)


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as int64."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise products of int64 rows. Floats are exact where no partial sum can reach 2**53; other rows take Python's integers. Beyond 64 bits: the nearest that fits."""
    x, y = q.astype(np.float64), c.astype(np.float64)
    out = np.einsum("ij,ij->i", x, y)
    large = np.square(x).sum(axis=1) * np.square(y).sum(axis=1) >= 2.0**105
    out = np.where(large, 0, out).astype(np.int64)
    for i in np.flatnonzero(large):
        out[i] = min(max(sum(a * b for a, b in zip(q[i].tolist(), c[i].tolist(), strict=True)), -MOST), MOST)
    return out


class Best:
    """The k best (score, smaller id, smaller row) of each slot so far; scores below `least` never count."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.score = np.full((len(least), k), LEAST, dtype=np.int64)
        self.id, self.row = np.zeros_like(self.score), np.zeros_like(self.score)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """More candidates, by slot; the threshold of a slot is then its k-th score, if it has k."""
        good = score >= self.least[slot]
        slot, score, ids, rows = slot[good], score[good], ids[good], rows[good]
        if not len(slot):
            return
        some = np.unique(slot)
        own = np.repeat(some, self.k)
        s, i, r = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.id[some].ravel(), ids]), np.concatenate([self.row[some].ravel(), rows])
        who = np.concatenate([own, slot])
        order = np.lexsort((r, i, ~s, who))  # ~s falls as s rises, without overflow
        who = who[order]
        begin = np.searchsorted(who, some)
        at = order[begin[:, None] + np.arange(self.k)[None]]
        self.score[some], self.id[some], self.row[some] = s[at], i[at], r[at]
        self.least[some] = np.maximum(self.least[some], self.score[some, -1])

    def held(self) -> tuple[np.ndarray, ...]:
        """slot, score, id, row of all that is held."""
        i, j = np.nonzero(self.score > LEAST)
        return i, self.score[i, j], self.id[i, j], self.row[i, j]
