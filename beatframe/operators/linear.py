"""Fixed linear reconstruction: small dense operators per ring, applied to any number of frames.

A matrix is elements x channels (about 1,500 x 32), so it travels with the task; frames are never gathered.
Where `ring` names a column, matrices are maps of ring to matrix and all rings are one job (rings.times).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.functions.arrays import TINY, dot, let, minus, quantile, rms, sum_squares
from beatframe.operators.rings import MAX_BYTES, times

Matrix = np.ndarray | dict[object, np.ndarray]

MAX_MATRIX = MAX_BYTES // 8  # numbers in a matrix that is sent to every task


def reconstruct(df: DataFrame, vector: str, matrix: Matrix, *, by: list[str], order: str, out: str = "reconstruction", ring: str | None = None) -> DataFrame:
    """LN1: matrix times the frame's difference to its group's first frame (of its ring, where that is given). Null where either frame is null, holds a null or has another width than the matrix."""
    w = Window.partitionBy(*by, *([ring] if ring else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return times(df.withColumn("_d", minus(vector, F.first(vector).over(w))), "_d", matrix, out, ring=ring).drop("_d")


def operators(jacobian: DataFrame, regulariser: DataFrame, *, h: float, ridge: float = 0.0, sign: float = 1.0) -> DataFrame:
    """LN2, LN3: (ring, elem_id, channel, value) of sign * (J'J + h^2 R + ridge I)^-1 J' for each ring; least squares where that is singular.

    jacobian: ring, channel, elem_id, value; regulariser: ring, i, j, value. One ring's matrices are one group; entries that
    repeat a place are summed before, so a group is no larger than its matrices.
    """
    jacobian = jacobian.groupBy("ring", "channel", "elem_id").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    regulariser = regulariser.groupBy("ring", "i", "j").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))

    def solve(j: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        n, m = int(j["elem_id"].max()) + 1, int(j["channel"].max()) + 1
        jac, reg = np.zeros((m, n)), np.zeros((n, n))
        np.add.at(jac, (j["channel"], j["elem_id"]), j["value"])
        np.add.at(reg, (r["i"], r["j"]), r["value"])
        left = jac.T @ jac + h * h * reg + ridge * np.eye(n)
        try:
            x = np.linalg.solve(left, jac.T)
            if not np.isfinite(x).all():
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            x = np.linalg.lstsq(left, jac.T, rcond=None)[0]
        e, c = np.indices(x.shape)
        return pd.DataFrame({"ring": j["ring"].iloc[0], "elem_id": e.ravel(), "channel": c.ravel(), "value": sign * x.ravel()})

    kind = dict(jacobian.dtypes)["ring"]
    return jacobian.groupBy("ring").cogroup(regulariser.groupBy("ring")).applyInPandas(solve, f"ring {kind}, elem_id long, channel long, value double")


def dense(operator: DataFrame, row: str, col: str, value: str = "value") -> np.ndarray:
    """One ring's operator as an array, on the driver; bounded by MAX_MATRIX."""
    n = operator.count()
    if n > MAX_MATRIX:
        raise ValueError(f"{n} entries are too many for one matrix")
    t = operator.select(row, col, value).toPandas()
    out = np.zeros((int(t[row].max()) + 1, int(t[col].max()) + 1))
    out[t[row], t[col]] = t[value]
    return out


def directions(df: DataFrame, *, voltage: str, state: str, jacobian: Matrix, inverse: Matrix, out: str = "direction", ring: str | None = None) -> DataFrame:
    """LN4: inverse times (V - J state); null where a vector is null, holds a null or has another width."""
    d = times(df, state, jacobian, "_f", ring=ring).withColumn("_r", minus(voltage, "_f"))
    return times(d, "_r", inverse, out, ring=ring).drop("_f", "_r")


def first_step(df: DataFrame, *, voltage: str, jacobian: Matrix, inverse: Matrix, out: str = "step", ring: str | None = None) -> DataFrame:
    """LN5: the step from zero, the residual RMS before it and after, and the step's RMS; null where the voltage is null, holds a null or has another width."""
    d = times(df, voltage, inverse, out, ring=ring)
    d = times(d, out, jacobian, "_f", ring=ring)
    return d.withColumn("residual_before", rms(voltage)).withColumn("residual_after", rms(minus(voltage, "_f"))).withColumn("step_rms", rms(out)).drop("_f")


def frame_solves(df: DataFrame, *, key: str, jacobian: str, residual: str, eigenvalues: np.ndarray, eigenvectors: np.ndarray, floor: float = 1e-10) -> DataFrame:
    """LN6: (J'J + R)^-1 J'r of each frame with its own Jacobian (array of channel rows): key, step, backward_error.

    R comes by its eigenbasis. Where it is positive definite the solve takes place among the channels (32,
    not 1,500); null modes or a backward error above 1e-7 take an augmented least squares solve.
    """
    definite = eigenvalues.min() > floor * eigenvalues.max()
    regulariser = (eigenvectors * eigenvalues) @ eigenvectors.T
    root = (eigenvectors * np.sqrt(np.maximum(eigenvalues, 0))).T
    n = len(eigenvalues)

    def solve(j: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps and backward errors of many frames at once: j is frames x channels x n."""
        rhs = np.einsum("fcn,fc->fn", j, r)
        size = np.maximum(np.linalg.norm(rhs, axis=1), 1e-300)
        error_of = lambda x: np.linalg.norm(np.einsum("fcn,fc->fn", j, np.einsum("fcn,fn->fc", j, x)) + x @ regulariser - rhs, axis=1) / size
        x, error = np.zeros((len(j), n)), np.full(len(j), np.inf)
        if definite and len(j):
            turned = j @ eigenvectors
            half = turned / eigenvalues
            inner = np.linalg.solve(half @ turned.transpose(0, 2, 1) + np.eye(j.shape[1]), r[:, :, None])
            x = (half.transpose(0, 2, 1) @ inner)[:, :, 0] @ eigenvectors.T
            error = error_of(x)
        bad = np.flatnonzero(~(error <= 1e-7))
        for f in bad:
            x[f] = np.linalg.lstsq(np.vstack([j[f], root]), np.concatenate([r[f], np.zeros(len(root))]), rcond=None)[0]
        if len(bad):
            error = error_of(x)
        return x, error

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                some = b.slice(a, 64)
                r = np.asarray(some.column(2).flatten(), dtype=np.float64).reshape(some.num_rows, -1)
                x, error = solve(np.asarray(some.column(1).flatten().flatten(), dtype=np.float64).reshape(*r.shape, n), r)
                steps = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * n, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), steps, pa.array(error)], names=[key, "step", "backward_error"])

    return df.select(key, jacobian, residual).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, step array<double>, backward_error double")


def linearised_voltage(df: DataFrame, *, state: str, baseline: str, voltage0: str, jacobian: Matrix, out: str = "voltage", ring: str | None = None) -> DataFrame:
    """LN7: V0 + J (state - baseline); null where a vector is null, holds a null or has another width."""
    d = times(df.withColumn("_d", minus(state, baseline)), "_d", jacobian, "_f", ring=ring)
    return d.withColumn(out, F.zip_with(voltage0, "_f", lambda a, b: a + b)).drop("_d", "_f")


def amplitude_fit(df: DataFrame, *, predicted: str, voltage: str, most: float) -> DataFrame:
    """LN8: amplitude clip(<p, v> / <p, p>, 0, most), zero where <p, p> <= 1e-24; and the residual v - amplitude p."""
    d = df.withColumn("_pp", sum_squares(predicted)).withColumn("_pv", dot(predicted, voltage))
    a = F.when(F.col("_pp") <= 1e-24, 0.0).otherwise(F.least(F.greatest(F.col("_pv") / F.greatest("_pp", F.lit(1e-300)), F.lit(0.0)), F.lit(most)))
    d = d.withColumn("amplitude", a)
    return d.withColumn("residual", minus(voltage, scaled_by(predicted, F.col("amplitude")))).drop("_pp", "_pv")


def scaled_by(vector: str, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def shape_fit(df: DataFrame, *, shape: str, predicted: str, voltage: str, base: str, most: float) -> DataFrame:
    """LN9: the shape at unit RMS, its amplitude on what the base leaves of the voltage, and the relative squared error."""
    d = df.withColumn("_rms", F.greatest(rms(shape), F.lit(TINY))).withColumn("_rest", minus(voltage, base)).withColumn("_p", F.transform(predicted, lambda x: x / F.col("_rms")))
    d = amplitude_fit(d, predicted="_p", voltage="_rest", most=most)
    return d.withColumn("unit_shape", F.transform(shape, lambda x: x / F.col("_rms"))).withColumn("relative_mse", sum_squares("residual") / F.greatest(sum_squares("_rest"), F.lit(1e-30))).drop("_rms", "_rest", "_p")


def context(df: DataFrame, vector: str, *, out: str = "context", most: float = 5.0) -> DataFrame:
    """LN10: clip(|d| / p95 of |d|, 0, most), by frame."""
    p = F.greatest(quantile(F.transform(vector, F.abs), 0.95), F.lit(TINY))
    return df.withColumn(out, let(p, lambda q: F.transform(vector, lambda x: F.least(F.abs(x) / q, F.lit(most)))))


def calibrated(df: DataFrame, *, voltage: str, reference: str, model0: str) -> DataFrame:
    """LN11: alpha = <m, m> / <ref, m> (1 where <ref, m> is zero), which scales the resting conductivity, and the residual (V - m) - (ref - m)."""
    product = dot(reference, model0)
    alpha = F.when(F.abs(product) > 1e-30, F.try_divide(sum_squares(model0), product)).otherwise(1.0)
    return df.withColumn("alpha", alpha).withColumn("differential", minus(minus(voltage, model0), minus(reference, model0)))


def dataset_residual(df: DataFrame, *, state: str, voltage: str, jacobian: Matrix, floor: float, ring: str | None = None) -> DataFrame:
    """LN12: RMS over all frames of V - J max(state, floor), and how many values were raised to the floor; by ring, where that is given. Frames without a product (see rings.times) take no part in the RMS."""
    raised = F.transform(state, lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(floor))))
    d = df.withColumn("_n", F.when(F.col(state).isNotNull(), F.size(F.filter(state, lambda x: x < floor)))).withColumn("_s", raised)
    d = times(d, "_s", jacobian, "_f", ring=ring).withColumn("_r", minus(voltage, "_f"))
    rms_of = F.sqrt(F.try_divide(F.sum(sum_squares("_r")), F.sum(F.when(sum_squares("_r").isNotNull(), F.size("_r")))))
    return d.groupBy(*([ring] if ring else [])).agg(rms_of.alias("residual_rms"), F.sum("_n").alias("clipped"))


def batch_scores(df: DataFrame, matrix: Matrix, *, vector: str, order: str, by: list[str], group: int = 50, out: str = "score", ring: str | None = None) -> DataFrame:
    """LN13, ST2: frames in order in groups of `group`, scored by the matrix; frames of a wrong width, of a ring without a matrix or with values that are null or not finite have valid false and no score."""
    d = df.withColumn("_v", F.when(F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.col(vector)))
    d = times(d.withColumn("group", F.floor(F.col(order) / group)), "_v", matrix, out, ring=ring)
    return d.withColumn("valid", F.col(out).isNotNull()).select(*by, order, "group", "valid", out)


