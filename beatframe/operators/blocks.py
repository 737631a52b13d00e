"""Filters and moving means over recordings of any length: blocks in parallel, and a scan over what blocks hand on.

A linear filter's state after a block is a matrix power of the state before it plus what the block's own samples leave, so a block
is known by a few numbers. Only those go through one task in order; samples stay in their blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.functions.tables import stored
from beatframe.operators.templates import butterworth, run_filter, steady_state

BLOCK = 65_536


def lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([np.asarray(r, dtype=np.float64) for r in rows], pa.list_(pa.float64()))


def powers_applied(a: np.ndarray, count: int, state: np.ndarray) -> np.ndarray:
    """The state after `count` samples of zero input."""
    n = len(a) - 1
    step = np.eye(n, k=1)
    step[:, 0] -= a[1:]
    return np.linalg.matrix_power(step, count) @ state


def lowpass(df: DataFrame, column: str, *, by: list[str], order: str, rate: float, cutoff: float = 5.0, block: int = BLOCK) -> DataFrame:
    """WN8: by, order, column and filtered, forwards and backwards; a group is one channel of one recording. Groups that are too short (12 samples or fewer) have NaN.

    A block is `block` values of order, so no task holds more samples of a recording; a group's scan holds a state and
    at most 26 samples for each of its blocks. The ends are extended by their odd reflection, as in
    templates.zero_phase, whose results these are. Null samples are NaN, which spreads. Null orders come last. Empty table: no rows.
    """
    b, a = butterworth(3, cutoff, rate)
    pad, rest = 3 * len(a), steady_state(b, a)
    n_state = len(rest)
    key = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_"))
    d = df.select(key.alias("keys"), F.to_json(key).alias("g"), F.floor(F.col(order) / block).cast("long").alias("at"), F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))).alias("x")).alias("s"))
    d = d.groupBy("g", "at").agg(F.array_sort(F.collect_list("s")).alias("s"), F.first("keys").alias("keys"))
    d = d.select("g", "at", "keys", F.transform("s", lambda s: s["order"]).alias("order"), F.transform("s", lambda s: s["x"]).alias("x"))

    def extended(schema: T.StructType, *names: str) -> T.StructType:
        return T.StructType([*schema.fields, *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])

    def summaries(batches):
        """What a block leaves in a filter that starts empty, its first and its last samples."""
        for batch in batches:
            xs = [np.asarray(x.values, dtype=np.float64) for x in batch["x"]]
            kicks = [run_filter(b, a, x, np.zeros(n_state))[1] for x in xs]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(kicks), lists([x[: pad + 1] for x in xs]), lists([x[-pad - 1 :] for x in xs]), pa.array([len(x) for x in xs], pa.int64())], names=[*batch.schema.names, "kick", "head", "tail", "n"])

    blocks = stored(d.mapInArrow(summaries, extended(d.schema, "kick", "head", "tail").add("n", T.LongType())))

    def in_order(t: pa.Table) -> pa.Table:
        return t.sort_by([("at", "ascending")])  # a null block, of null orders, comes last

    def forwards(t: pa.Table) -> pa.Table:
        """Each block's state at its begin, and the outputs over the extension behind the last."""
        t = in_order(t)
        heads, tails, kicks, sizes = (t[c].to_pylist() for c in ("head", "tail", "kick", "n"))
        states, after = [None] * len(sizes), None
        if sum(sizes) > pad:
            first, last = [], []
            for h in heads:
                first += h if len(first) <= pad else []
            for v in reversed(tails):
                last = v + last if len(last) <= pad else last
            first, last = np.array(first[: pad + 1]), np.array(last[-pad - 1 :])
            before = 2 * first[0] - first[:0:-1]
            state = run_filter(b, a, before, rest * before[0])[1]
            for i, (kick, size) in enumerate(zip(kicks, sizes, strict=True)):
                states[i] = state.tolist()
                state = powers_applied(a, size, state) + np.array(kick)
            after = run_filter(b, a, 2 * last[-1] - last[-2::-1], state)[0].tolist()
        kind = pa.list_(pa.float64())
        return pa.table({"g": t["g"], "at": t["at"], "state": pa.array(states, kind), "after": pa.array([after] * len(sizes), kind)})

    def backwards(t: pa.Table) -> pa.Table:
        t = in_order(t)
        states = [None] * len(t)
        if t["after"][0].is_valid:
            after = np.array(t["after"][0].as_py())[::-1]
            state = run_filter(b, a, after, rest * after[0])[1]
            for i, (kick, size) in reversed(list(enumerate(zip(t["back"].to_pylist(), t["n"].to_pylist(), strict=True)))):
                states[i] = state.tolist()
                state = powers_applied(a, size, state) + np.array(kick)
        return pa.table({"g": t["g"], "at": t["at"], "state": pa.array(states, pa.list_(pa.float64()))})

    def filtered(batches):
        """Outputs of the first pass, and what they leave in the second, that runs backwards."""
        for batch in batches:
            xs, states = batch["x"], batch["state"]
            ys = [run_filter(b, a, np.asarray(x.values, dtype=np.float64), np.array(s.as_py()))[0] if s.is_valid else np.full(len(x.values), np.nan) for x, s in zip(xs, states, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(ys), lists([run_filter(b, a, y[::-1], np.zeros(n_state))[1] for y in ys])], names=[*batch.schema.names, "y", "back"])

    def finished(batches):
        for batch in batches:
            ys, states = batch["y"], batch["state"]
            out = [run_filter(b, a, np.asarray(y.values)[::-1], np.array(s.as_py()))[0][::-1] if s.is_valid else np.full(len(y.values), np.nan) for y, s in zip(ys, states, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(out)], names=[*batch.schema.names[:3], "filtered"])

    narrow = T.StructType([T.StructField("g", T.StringType()), T.StructField("at", T.LongType()), T.StructField("state", T.ArrayType(T.DoubleType()))])
    scan = blocks.select("g", "at", "kick", "head", "tail", "n").groupBy("g").applyInArrow(forwards, extended(narrow, "after"))
    scan = stored(scan)
    same = lambda x, y: x["g"].eqNullSafe(y["g"]) & x["at"].eqNullSafe(y["at"])
    first = blocks.join(scan, same(blocks, scan)).select(blocks["g"], blocks["at"], "keys", "order", "x", "state", "n", "after")
    passed = first.mapInArrow(filtered, extended(first.schema, "y", "back"))
    passed = stored(passed)
    back = stored(passed.select("g", "at", "back", "n", "after").groupBy("g").applyInArrow(backwards, narrow))
    second = passed.join(back, same(passed, back)).select("keys", "order", "x", "y", back["state"].alias("state"))
    done = second.mapInArrow(finished, extended(T.StructType(second.schema.fields[:3]), "filtered"))
    rows = done.select("keys.*", F.explode(F.arrays_zip("order", "x", "filtered")).alias("s")).drop("_")
    return rows.select(*by, F.col("s.order").alias(order), F.col("s.x").alias(column), F.col("s.filtered").alias("filtered"))


def positions(df: DataFrame, *, by: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """df with _p, the row's number in its group from 0: counted inside blocks of order, and over blocks."""
    d = df.withColumn("_b", F.floor(F.col(order) / block))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order)) - 1
    before = Window.partitionBy(*by).orderBy(F.asc_nulls_last("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*by, "_b").count().withColumn("_n", F.coalesce(F.sum("count").over(before), F.lit(0))).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_b"])], "_n")
    ranked = d.withColumn("_i", inside)
    on = F.lit(True)
    for i, c in enumerate([*by, "_b"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(base, on).withColumn("_p", F.col("_i") + F.col("_n")).drop("_b", "_i", "_n", *[f"_k{i}" for i in range(len(by) + 1)])


def moving_mean(df: DataFrame, column: str, *, by: list[str], order: str, window: int = 100, block: int = BLOCK, out: str = "lp") -> DataFrame:
    """WN1 for recordings longer than a task: df with the centred mean of signals.moving_mean.

    Rows near a block's border go to both blocks (a halo of half a window), so that each block has all
    that its means need; blocks and halos go by row numbers, whatever gaps order has.
    """
    ahead, behind = window - window // 2 - 1, window // 2
    d = positions(df, by=by, order=order, block=block)
    size = max(block, window)
    low, high = F.floor((F.col("_p") - ahead) / size), F.floor((F.col("_p") + behind) / size)
    d = d.withColumn("_at", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    w = Window.partitionBy(*by, "_at").orderBy("_p").rowsBetween(-behind, ahead)
    mine: Column = F.floor(F.col("_p") / size) == F.col("_at")
    return d.withColumn(out, F.avg(column).over(w)).filter(mine).drop("_p", "_at")
