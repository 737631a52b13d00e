"""Beat templates and zero-phase filtering: small dense work on one beat or one channel at a time."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.functions.arrays import norm
from beatframe.functions.quantiles import exact_percentiles


def butterworth(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients by the bilinear transform of the analogue prototype."""
    if not 0 < cutoff < rate / 2:
        raise ValueError("the cutoff must lie below half the sampling rate")
    k = np.arange(1, order + 1)
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    poles = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    gain = np.real(warped**order / np.prod(2 * rate - poles))
    return gain * np.poly(-np.ones(order)), np.real(np.poly((2 * rate + poles) / (2 * rate - poles)))


@cache
def block_form(b: tuple, a: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The filter (direct form II transposed) over `size` samples as matrices: state step, what the inputs do to the end state, what the start state and the inputs do to the outputs."""
    b, a = np.array(b), np.array(a)
    n = len(a) - 1
    step = np.eye(n, k=1)
    step[:, 0] -= a[1:]
    kick = b[1:] - a[1:] * b[0]
    powers = [np.eye(n)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    reach = np.stack([powers[size - 1 - k] @ kick for k in range(size)], axis=1)
    observe = np.stack([p[0] for p in powers[:size]])
    impulse = np.concatenate([[b[0]], [p[0] @ kick for p in powers[: size - 1]]])
    lag = np.arange(size)[:, None] - np.arange(size)[None]
    return step, reach, observe, np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, size: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The filtered samples and the state after them, block by block."""
    step, reach, observe, inputs = block_form(tuple(b), tuple(a), size)
    whole = len(x) // size
    blocks = x[: whole * size].reshape(whole, size)
    kicks, power = blocks @ reach.T, np.linalg.matrix_power(step, size)
    states = np.empty((whole + 1, len(state)))
    states[0] = state
    for i in range(whole):
        states[i + 1] = power @ states[i] + kicks[i]
    y = blocks @ inputs.T + states[:-1] @ observe.T
    rest = x[whole * size :]
    m = len(rest)
    last = inputs[:m, :m] @ rest + observe[:m] @ states[-1]
    return np.concatenate([y.ravel(), last]), np.linalg.matrix_power(step, m) @ states[-1] + reach[:, size - m :] @ rest


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of the filter after a constant input of one."""
    n = len(a) - 1
    companion = np.eye(n, k=1)
    companion[:, 0] = -a[1:]
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def zero_phase(x: np.ndarray, rate: float, *, cutoff: float = 5.0, order: int = 3) -> np.ndarray:
    """Forwards and backwards over the signal, extended at both ends by its odd reflection."""
    b, a = butterworth(order, cutoff, rate)
    pad = 3 * len(a)
    if len(x) <= pad:
        raise ValueError(f"{len(x)} samples are too few; more than {pad} are needed")
    z = steady_state(b, a)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y = run_filter(b, a, y, z * y[0])[0][::-1]
    return y[pad:-pad]


def rank_one(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Temporal scores and spatial pattern of the leading mode of the centred beat; the pattern's largest loading is positive."""
    u, s, w = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    sign = 1.0 if w[0, np.argmax(np.abs(w[0]))] >= 0 else -1.0
    return sign * u[:, 0] * s[0], sign * w[0]


def first_largest(x: np.ndarray) -> int:
    """Index of the first value that is the largest but for rounding."""
    return int(np.argmax(x >= (1 - 1e-9) * x.max()))


def template(v: np.ndarray, mode: str) -> np.ndarray:
    """The template of a beat, from its leading mode after the mean is taken off. positive: at its strongest positive frame; absolute: at the frame of largest absolute score; row: its row of largest RMS. A constant beat's is zero."""
    if mode not in ("positive", "absolute", "row"):
        raise ValueError(mode)
    t, w = rank_one(v)
    if mode == "positive":
        return t.max() * w
    if mode == "absolute":
        return t[first_largest(np.abs(t))] * w
    rows = np.outer(t, w)
    return rows[first_largest(np.sqrt((rows**2).mean(axis=1)))]


def beat_templates(df: DataFrame, vector: str, *, by: list[str], order: str, mode: str = "positive") -> DataFrame:
    """WN14, WN15: by, template. A group is one beat (50 frames)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf.sort_values(order)[vector].to_numpy()).astype(np.float64)
        return pd.DataFrame([[*pdf[by].iloc[0], template(v, mode)]], columns=[*by, "template"])

    kinds = dict(df.dtypes)
    return df.select(*by, order, vector).groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "template array<double>"]))


def group_templates(templates: DataFrame, group: str) -> DataFrame:
    """WN16: of each group's beat templates, scaled to length one, the leading right vector, signed like their sum, times their median length.

    That vector is the leading eigenvector of the templates' second moments, channels x channels. Every task sums the moments of
    its own rows (a matrix for each group it meets), and one matrix for each group and task is shuffled; median lengths are exact
    without gathering a group (functions.quantiles). Null templates, and those of another width than the group's first, take no part.
    """
    kind = templates.schema[group].dataType
    numbers = T.ArrayType(T.DoubleType())
    t = templates.select(F.col(group).alias("g"), F.col("template").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    widths = t.groupBy("g").agg(F.min(F.size("v")).alias("n"))
    t = t.join(widths.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).filter(F.size("v") == F.col("n")).select("g", "v")
    schema = T.StructType([T.StructField("g", kind), T.StructField("moments", numbers), T.StructField("total", numbers)])

    def summed(batches):
        held: dict = {}
        for b in batches:
            codes = b.column(0).dictionary_encode("encode")
            number = np.asarray(codes.indices)
            for i, g in enumerate(codes.dictionary.to_pylist()):
                v = np.stack([np.asarray(x.values, dtype=np.float64) for x in b.column(1).filter(pa.array(number == i))])
                unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                m, s = held.get(g, (0.0, 0.0))
                held[g] = m + unit.T @ unit, s + unit.sum(axis=0)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), b.column(0).type), pa.array([m.ravel() for m, _ in held.values()], pa.list_(pa.float64())), pa.array([s for _, s in held.values()], pa.list_(pa.float64()))], names=schema.names)

    def leading(parts: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x.values) for x in parts["total"].combine_chunks()], axis=0)
        m = np.sum([np.asarray(x.values) for x in parts["moments"].combine_chunks()], axis=0).reshape(len(total), -1)
        w = np.linalg.eigh(m)[1][:, -1]
        return pa.table({"g": parts["g"][:1], "w": pa.array([w if w @ total >= 0 else -w], pa.list_(pa.float64()))})

    modes = t.mapInArrow(summed, schema).groupBy("g").applyInArrow(leading, T.StructType([T.StructField("g", kind), T.StructField("w", numbers)]))
    sizes = exact_percentiles(t.select("g", norm("v").alias("size")), ["g"], "size", {"median": 0.5}).withColumnRenamed("g", "_g")
    return modes.join(sizes, F.col("g").eqNullSafe(F.col("_g"))).select(F.col("g").alias(group), F.transform("w", lambda x: x * F.col("median")).alias("template"))


def centre_stability(df: DataFrame, *, beat: str, centres: str) -> DataFrame:
    """WN17: of each beat the mean deviation of slot centres (sorted by x in every frame), then its mean and largest value."""
    slots = df.select(beat, F.posexplode(F.array_sort(centres)).alias("slot", "c"))
    s = slots.groupBy(beat, "slot").agg(((F.stddev_pop("c.x") + F.stddev_pop("c.y")) / 2).alias("s")).groupBy(beat).agg(F.avg("s").alias("s"))
    return s.agg(F.avg("s").alias("mean"), F.max("s").alias("max"))
