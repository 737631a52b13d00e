"""Matrices of many rings at once: bounded maps of ring to matrix that go to the tasks, so frames stay where they are.

A frame takes the matrix of its own ring. Sparse matrices are compressed rows and never become dense. One rule holds for every
path: entries meet components by column; a product with a null side is null and left out of the sum; NaN
and infinity take part as numbers do; a row's result is null where all its products are; rows none of whose
columns lies inside the vector have no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.functions.arrays import long

MAX_BYTES = 64_000_000  # of all matrices that go to every task together
_ALL = "_all"


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: the rows' numbers, where each begins, columns and values; known is false at null values."""

    rows: np.ndarray
    begin: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray, known: np.ndarray) -> Csr:
        order = np.lexsort((col, row))
        row = row[order]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        return cls(row[begin], begin, col[order], value[order], known[order])

    @property
    def width(self) -> int:
        return int(self.cols.max(initial=-1)) + 1

    def times(self, x: np.ndarray, there: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For frames x (zero where `there` is false; size components each): results, whether they are not null, and whether they exist; all frames x rows."""
        frames, rows = len(x), len(self.rows)
        if not frames or not rows:
            return np.zeros((frames, rows)), np.zeros((frames, rows), bool), np.zeros((frames, rows), bool)
        if there.all() and self.known.all():  # nothing is null, and no vector too short
            y = np.add.reduceat(self.values * x[:, self.cols], self.begin, axis=1)
            return y, np.ones(y.shape, bool), np.ones(y.shape, bool)
        meets = there[:, self.cols] & self.known
        y = np.add.reduceat(np.where(meets, self.values * x[:, self.cols], 0.0), self.begin, axis=1)
        inside = self.cols[None] < size[:, None]
        return y, np.logical_or.reduceat(meets, self.begin, axis=1), np.logical_or.reduceat(inside, self.begin, axis=1)


def collected(coo: DataFrame, columns: list[str], ring: str | None) -> dict | None:
    """Arrow columns of each ring (None for the only one), or None where all of it is above MAX_BYTES; one job finds out."""
    most = MAX_BYTES // (8 * (len(columns) + 1))
    t = coo.select(*([ring] if ring else []), *columns).limit(most + 1).toArrow()
    if len(t) > most:
        return None
    if ring is None:
        return {_ALL: t}
    rings = t[ring].to_pylist()
    at: dict = {}
    for i, r in enumerate(rings):
        if r is not None:
            at.setdefault(r, []).append(i)
    return {r: t.take(pa.array(i)) for r, i in at.items()}


def sparse_by_ring(coo: DataFrame, ring: str | None = None) -> dict[object, Csr] | None:
    """The matrices of coo (row, col, value and, where there are several, ring), or None where they are too large to send. Null rows, null or negative columns and null rings meet nothing; repeated entries add up."""
    coo = coo.filter("row is not null and col >= 0").select(*([ring] if ring else []), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    found = collected(coo, ["row", "col", "value"], ring)
    if found is None:
        return None
    out = {}
    for r, t in found.items():
        value = t["value"].combine_chunks()
        out[r] = Csr.of(*(t[c].to_numpy() for c in ("row", "col")), value.fill_null(0.0).to_numpy(zero_copy_only=False), value.is_valid().to_numpy(zero_copy_only=False))
    return out


def dense_by_ring(operator: DataFrame, row: str, col: str, value: str = "value", *, ring: str = "ring") -> dict[object, np.ndarray]:
    """Arrays of each ring's operator, for LN1 and those after it; refuses more than MAX_BYTES."""
    found = collected(operator, [row, col, value], ring)
    if found is None:
        raise ValueError(f"the operators of all rings are above {MAX_BYTES} bytes")
    out = {}
    for r, t in found.items():
        i, j = t[row].to_numpy(), t[col].to_numpy()
        if 8 * (int(i.max()) + 1) * (int(j.max()) + 1) > MAX_BYTES:
            raise ValueError(f"the operator of ring {r} is above {MAX_BYTES} bytes")
        out[r] = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
        np.add.at(out[r], (i, j), t[value].to_numpy().astype(np.float64))
    return out


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames x width from a list column of doubles: values (zero where there is none), whether there is one, and sizes; a null vector has size -1."""
    size = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)).astype(np.int64), -1)
    flat = column.flatten()
    full = np.append(np.asarray(flat.fill_null(0.0), dtype=np.float64), 0.0)
    known = np.append(np.asarray(flat.is_valid()), False)
    begin = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
    at = np.arange(width)
    place = np.where(at[None] < size[:, None], begin[:, None] + at[None], len(full) - 1)
    return full[place], known[place], size


def by_ring(column: pa.Array | None, n: int) -> Iterator[tuple[object, np.ndarray]]:
    """Each ring of a batch with the places of its frames; frames without a ring are in none."""
    if column is None:
        yield _ALL, np.arange(n)
        return
    codes = column.dictionary_encode()
    number = np.asarray(codes.indices.fill_null(-1))
    for i, r in enumerate(codes.dictionary.to_pylist()):
        yield r, np.flatnonzero(number == i)


def apply_sparse(coo: DataFrame, frames: DataFrame, key: list[str], vector: str, *, ring: str | None = None) -> DataFrame:
    """MG1: matrix times each frame's vector, in long form: key, row, y; with ring, each frame's own ring's matrix, for all rings in one job.

    Matrices of up to MAX_BYTES together go to the tasks as compressed rows, and nothing is shuffled; larger
    ones are joined to the components. Both follow the rule above. Frames with a null vector, or of a ring without a matrix, have no rows.
    """
    coo = coo.filter("row is not null and col >= 0")
    matrices = sparse_by_ring(coo, ring)
    if matrices is None:
        on = [*([ring] if ring else []), "col"]
        x = long(frames.select(*dict.fromkeys([*key, *on[:-1]]), F.col(vector).cast("array<double>").alias("_v")), "_v", index="col", value="_x")
        entries = coo.select(*on, "row", F.col("value").cast("double").alias("_a"))
        return entries.join(x, on).groupBy(*key, "row").agg(F.sum(F.col("_a") * F.col("_x")).alias("y"))
    d = frames.select(*key, *([F.col(ring).alias("_ring")] if ring else []), F.col(vector).cast("array<double>").alias("_v"))
    schema = T.StructType([*(d.schema[k] for k in key), T.StructField("row", coo.schema["row"].dataType), T.StructField("y", T.DoubleType())])
    kind = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8()}[coo.schema["row"].dataType.simpleString()]
    shared = frames.sparkSession.sparkContext.broadcast(matrices)

    def run(batches):
        for b in batches:
            rings, v = (b.column(len(key)) if ring else None), b.column(b.num_columns - 1)
            for r, places in by_ring(rings, b.num_rows):
                m = shared.value.get(r)
                if m is None or not len(m.rows):
                    continue
                step = max(1, 4_000_000 // max(1, len(m.cols)))
                for a in range(0, len(places), step):
                    some = places[a : a + step]
                    x, there, size = vectors_of(v.take(pa.array(some)), m.width)
                    y, known, exists = m.times(x, there, size)
                    f, row = np.nonzero(exists)
                    take = pa.array(some[f])
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(key))), pa.array(m.rows[row], kind), pa.array(y[f, row], mask=~known[f, row])], names=[*key, "row", "y"])

    return d.mapInArrow(run, schema)


def images(coo: DataFrame, frames: DataFrame, key: list[str], vector: str, *, side: int, ring: str | None = None) -> DataFrame:
    """MG2 in one row for each frame: key, image (side * side pixels in the order of p, NaN where no element covers one). Needs matrices that fit MAX_BYTES; frames with a null vector, or of a ring without a matrix, are all NaN."""
    matrices = sparse_by_ring(coo, ring)
    if matrices is None:
        raise ValueError(f"matrices above {MAX_BYTES} bytes are for apply_sparse")
    d = frames.select(*key, *([F.col(ring).alias("_ring")] if ring else []), F.col(vector).cast("array<double>").alias("_v"))
    shared = frames.sparkSession.sparkContext.broadcast(matrices)
    n = side * side

    def run(batches):
        for b in batches:
            rings, v = (b.column(len(key)) if ring else None), b.column(b.num_columns - 1)
            for a in range(0, b.num_rows, max(1, 4_000_000 // n)):
                part, kinds = v.slice(a, max(1, 4_000_000 // n)), rings.slice(a, max(1, 4_000_000 // n)) if ring else None
                out = np.full((len(part), n), np.nan)
                for r, places in by_ring(kinds, len(part)):
                    m = shared.value.get(r)
                    if m is None or not len(m.rows):
                        continue
                    on_image = (m.rows >= 0) & (m.rows < n)
                    for s in range(0, len(places), max(1, 4_000_000 // max(1, len(m.cols)))):
                        some = places[s : s + max(1, 4_000_000 // max(1, len(m.cols)))]
                        y, known, _ = m.times(*vectors_of(part.take(pa.array(some)), m.width))
                        out[np.ix_(some, m.rows[on_image])] = np.where(known, y, np.nan)[:, on_image]
                image = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * n, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, len(part)) for i in range(len(key))), image], names=[*key, "image"])

    return d.mapInArrow(run, T.StructType([*(d.schema[k] for k in key), T.StructField("image", T.ArrayType(T.DoubleType()))]))


def times(df: DataFrame, vector: str, matrix: np.ndarray | dict[object, np.ndarray], out: str, *, ring: str | None = None) -> DataFrame:
    """LN1, LN4: adds matrix times each frame's vector, batch by batch; with ring, matrix is a map of ring to matrix, and all rings are one job.

    Null results: null vectors, vectors that hold a null or are not as wide as the matrix, and frames whose
    ring has none. NaN and infinity are numbers. Refuses matrices above MAX_BYTES together.
    """
    matrices = {k: np.asarray(m, dtype=np.float64) for k, m in (matrix if ring else {_ALL: matrix}).items()}
    if sum(m.nbytes for m in matrices.values()) > MAX_BYTES:
        raise ValueError(f"matrices of {sum(m.nbytes for m in matrices.values())} bytes are too large to send to every task")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    at, own = df.columns.index(vector), df.columns.index(ring) if ring else None
    shared = df.sparkSession.sparkContext.broadcast(matrices)

    def run(batches):
        for b in batches:
            length, results, places = np.full(b.num_rows, -1), [], []
            for r, some in by_ring(b.column(own) if ring else None, b.num_rows):
                m = shared.value.get(r)
                if m is None or not len(some):
                    continue
                v = b.column(at).take(pa.array(some)).cast(pa.list_(pa.float64()))
                x, there, size = vectors_of(v, m.shape[1])
                good = (size == m.shape[1]) & there.all(axis=1)
                length[some[good]] = len(m)
                places.append(some[good])
                results.append(x[good] @ m.T)
            order = np.argsort(np.concatenate([np.zeros(0, np.int64), *places]), kind="stable")
            flat = [y for part in results for y in part]
            flat = np.concatenate([np.zeros(0), *(flat[i] for i in order.tolist())]) if len(results) > 1 else (results[0].ravel() if results else np.zeros(0))
            ends = np.concatenate([[0], np.cumsum(np.maximum(length, 0))]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(length < 0))
            yield pa.RecordBatch.from_arrays([*b.columns, held], names=schema.names)

    return df.mapInArrow(run, schema)


