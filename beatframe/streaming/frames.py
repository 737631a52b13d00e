"""Streams of frames (session, frame_no, ts, v): buffers, reference epochs, causal filtering.

Each has a batch twin: buffers are tumbling(), epochs reference_epochs() of operators.signals.
Frames may arrive late, out of order or twice within the watermark: accepted() drops repeats, and a
session's frames wait in its state until the watermark has passed them, then go on in order. So state
holds the frames of one delay, and one partial buffer, reference or filter state; it goes when the watermark
is `idle` past a session's last frame (see InOrder). Two streams are paired by live_pairs, watched by LiveMonitor.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from beatframe.operators.templates import butterworth, run_filter, steady_state

KEY = [T.StructField("session", T.StringType()), T.StructField("frame_no", T.LongType())]


def accepted(frames: DataFrame, *, delay: str = "10 seconds") -> DataFrame:
    """The stream with event time and without repeated frames."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "frame_no"])


class InOrder(StatefulProcessor):
    """Runs step(session, rows in order, state or None, last) -> (output, state) over the frames of a session that the watermark has passed; last says that the session has ended.

    State: waiting, a map of frame number to the frame, of which each frame is written once and removed once; held, step's
    own state, written when frames went on; ends, when the session's timer is due. One timer is at the latest waiting frame, one at
    the session's end, `idle` seconds past it, which clears all of it. So a trigger writes what is new, and nothing anew.
    """

    def __init__(self, columns: list[str], waiting: T.StructType, state: T.StructType, step: Callable, idle: float):
        self.columns, self.schema, self.state_schema, self.step, self.idle_ms = columns, waiting, state, step, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("frame_no", T.LongType())]), self.schema)
        self.held = handle.getValueState("held", self.state_schema)
        self.ends = handle.getValueState("ends", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for b in rows:
            b.columns = ["session", "frame_no", "ts", "_ms", *self.columns]  # Spark names what stateful() computed by its place
            for n, ms, *values in zip(b["frame_no"].tolist(), b["_ms"].tolist(), *(b[c].tolist() for c in self.columns), strict=True):
                if not self.waiting.containsKey((n,)):  # a frame that came twice waits once
                    self.waiting.updateValue((n,), (ms, *(v.tolist() if isinstance(v, np.ndarray) else v for v in values)))
                latest = ms if latest is None else max(latest, ms)
        now = timerValues.getCurrentWatermarkInMs()
        if latest is not None:
            self._end_at(max(latest, now) + self.idle_ms)
            if latest > now:
                self.handle.registerTimer(latest)
        yield from self._release(key[0], now, ended=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ended = self.ends.exists() and self.ends.get()[0] <= expiredTimerInfo.getExpiryTimeInMs()
        yield from self._release(key[0], now, ended=ended)
        if ended:
            for s in (self.waiting, self.held, self.ends):
                s.clear()

    def _end_at(self, ms: int) -> None:
        before = self.ends.get()[0] if self.ends.exists() else None
        if before is None or ms > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.ends.update((ms,))

    def _release(self, session: str, now: int, *, ended: bool) -> Iterator[pd.DataFrame]:
        due = sorted((k[0], *v) for k, v in self.waiting.iterator() if ended or v[0] <= now)
        for w in due:
            self.waiting.removeKey((w[0],))
        before = self.held.get() if self.held.exists() else None
        if not due and not (ended and before is not None):
            return
        result, new = self.step(session, pd.DataFrame(due, columns=["frame_no", "ts", *self.columns]), before, ended)
        if len(result):
            yield result
        if not ended:
            self.held.update(new)

    def close(self) -> None:
        pass


def stateful(frames: DataFrame, columns: list[str], out: T.StructType, state: T.StructType, step: Callable, *, idle: float = 60.0) -> DataFrame:
    """The stream of step's output over each session's frames in order (see InOrder). columns: what step needs beside frame_no. State is kept by RocksDB, which is set for the session's queries where no other provider is."""
    conf, name = frames.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(name):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {f.name: f.dataType for f in frames.schema}
    waiting = T.StructType([T.StructField("ts", T.LongType()), *(T.StructField(c, kinds[c]) for c in columns)])
    rows = frames.select("session", "frame_no", "ts", F.unix_millis("ts").alias("_ms"), *columns)
    return rows.groupBy("session").transformWithStateInPandas(InOrder(columns, waiting, state, step, idle), out, "Append", "EventTime")


def buffers(frames: DataFrame, *, size: int = 50) -> DataFrame:
    """ST1: session, buffer, first_frame, frames, numbers and values of each full buffer of `size` consecutive frames, in order; a session's end gives its last, shorter one."""

    def step(session, rows, state, ended):
        number, numbers, values = (state[0], list(state[1]), [list(v) for v in state[2]]) if state else (0, [], [])
        out = []
        for n, v in zip(rows["frame_no"].tolist(), rows["v"], strict=True):
            numbers.append(n)
            values.append([float(x) for x in v])
            if len(numbers) == size:
                out.append((session, number, numbers[0], size, numbers, values))
                number, numbers, values = number + 1, [], []
        if ended and numbers:
            out.append((session, number, numbers[0], len(numbers), numbers, values))
        return pd.DataFrame(out, columns=["session", "buffer", "first_frame", "frames", "numbers", "values"]), (number, numbers, values)

    whole = T.ArrayType(T.LongType()), T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([T.StructField("session", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("buffer", "first_frame", "frames")), T.StructField("numbers", whole[0]), T.StructField("values", whole[1])])
    state = T.StructType([T.StructField("number", T.LongType()), T.StructField("numbers", whole[0]), T.StructField("values", whole[1])])
    return stateful(frames, ["v"], schema, state, step)


def scored_buffers(buffered: DataFrame, matrix: np.ndarray) -> DataFrame:
    """ST2: buffers with scores, the matrix applied to each of a buffer's frames, in their order; the matrix stays with the task from buffer to buffer. Buffers with a frame of a wrong width or with values that are not finite have valid false and no scores."""
    matrix = np.asarray(matrix, dtype=np.float64)
    schema = T.StructType([*buffered.schema.fields, T.StructField("valid", T.BooleanType()), T.StructField("scores", T.ArrayType(T.ArrayType(T.DoubleType())))])
    at = buffered.columns.index("values")

    def run(batches):
        for b in batches:
            scores = []
            for x in b.column(at).to_pylist():
                good = all(len(v) == matrix.shape[1] for v in x) and np.isfinite(np.array(x, dtype=np.float64)).all()
                scores.append((np.array(x, dtype=np.float64) @ matrix.T).tolist() if good else None)
            kind = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s is not None for s in scores]), pa.array(scores, kind)], names=schema.names)

    return buffered.mapInArrow(run, schema)


def scored(frames: DataFrame, matrix: np.ndarray, *, out: str = "score") -> DataFrame:
    """ST2: the matrix applied to each frame, with its session and number; the same in batch and stream."""
    from beatframe.operators.linear import times

    return times(frames, "v", matrix, out)


def epochs(frames: DataFrame, *, size: int = 250) -> DataFrame:
    """ST3: each frame minus its reference, the first of an epoch; a new epoch after `size` frames, a reset or a gap."""

    def step(session, rows, state, ended):
        last, epoch, seen, reference = (state[0], state[1], state[2], np.array(state[3])) if state else (None, -1, 0, None)
        out = []
        for n, v, reset in zip(rows["frame_no"], rows["v"], rows["reset"], strict=True):
            v = np.asarray(v, dtype=np.float64)
            if last is None or reset or n != last + 1 or seen == size:
                epoch, seen, reference = epoch + 1, 0, v
            last, seen = int(n), seen + 1
            out.append((session, last, epoch, (v - reference).tolist()))
        return pd.DataFrame(out, columns=["session", "frame_no", "epoch", "delta"]), (last, epoch, seen, [] if reference is None else reference.tolist())

    schema = T.StructType([*KEY, T.StructField("epoch", T.LongType()), T.StructField("delta", T.ArrayType(T.DoubleType()))])
    state = T.StructType([T.StructField("last", T.LongType()), T.StructField("epoch", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("reference", T.ArrayType(T.DoubleType()))])
    return stateful(frames, ["v", "reset"], schema, state, step)


def causal_lowpass(frames: DataFrame, *, rate: float, cutoff: float = 5.0, warm_up: int = 50) -> DataFrame:
    """ST4: raw and filtered channels by a causal third-order low-pass whose state goes on from batch to batch; the first `warm_up` frames are flagged not valid."""
    b, a = butterworth(3, cutoff, rate)
    rest = steady_state(b, a)

    def step(session, rows, state, ended):
        last, seen, z = (state[0], state[1], np.array(state[2]).reshape(-1, len(rest)) if state[2] else None) if state else (None, 0, None)
        if rows.empty:
            return pd.DataFrame([], columns=["session", "frame_no", "v", "filtered", "valid"]), (last, seen, [] if z is None else z.ravel().tolist())
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        z = rest[None] * x[0][:, None] if z is None else z
        done = [run_filter(b, a, x[:, c], z[c]) for c in range(x.shape[1])]
        y = np.stack([d[0] for d in done], axis=1)
        valid = np.arange(seen, seen + len(rows)) >= warm_up
        out = pd.DataFrame({"session": session, "frame_no": rows["frame_no"].to_numpy(), "v": list(x), "filtered": list(y), "valid": valid})
        return out, (int(rows["frame_no"].iloc[-1]), seen + len(rows), np.concatenate([d[1] for d in done]).tolist())

    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*KEY, T.StructField("v", array), T.StructField("filtered", array), T.StructField("valid", T.BooleanType())])
    state = T.StructType([T.StructField("last", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("z", array)])
    return stateful(frames, ["v"], schema, state, step)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST5: two methods' outputs (value) at the same frame, those that both have; of tables. See live_pairs for streams."""
    keys = ["session", "frame_no", *(["ts"] if "ts" in a.columns and "ts" in b.columns else [])]
    return a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), keys)


def live_pairs(a: DataFrame, b: DataFrame, *, delay: str = "10 seconds", apart: str = "5 seconds") -> DataFrame:
    """ST5 on streams or tables (session, frame_no, ts, value): session, frame_no, ts_a, ts_b, value_a, value_b, missing.

    Both sides may be late by `delay`; outputs of a frame belong together if their times are no further than `apart`.
    missing names the method (a or b) that had no output for a frame once the watermark rules one out; null where both
    had. State of a stream goes with the watermark. Repeated outputs pair each with each; null sessions or numbers pair with nothing.
    """
    left = a.select(F.col("session").alias("_sa"), F.col("frame_no").alias("_na"), F.col("ts").alias("ts_a"), F.col("value").alias("value_a"), F.lit(True).alias("_a")).withWatermark("ts_a", delay)
    right = b.select(F.col("session").alias("_sb"), F.col("frame_no").alias("_nb"), F.col("ts").alias("ts_b"), F.col("value").alias("value_b"), F.lit(True).alias("_b")).withWatermark("ts_b", delay)
    on = F.expr(f"_sa = _sb AND _na = _nb AND ts_a >= ts_b - INTERVAL {apart} AND ts_a <= ts_b + INTERVAL {apart}")
    missing = F.when(F.col("_b").isNull(), "b").when(F.col("_a").isNull(), "a")
    return left.join(right, on, "full").select(F.coalesce("_sa", "_sb").alias("session"), F.coalesce("_na", "_nb").alias("frame_no"), "ts_a", "ts_b", "value_a", "value_b", missing.alias("missing"))


def buffer_monitor(timings: DataFrame, *, hz: float = 50.0) -> DataFrame:
    """ST6: of each session's buffers (frames, compute_s), time to fill and compute, and whether they keep up with hz."""
    fill = F.col("frames") / hz
    return timings.groupBy("session").agg(F.avg(fill + F.col("compute_s")).alias("first_output_s"), F.avg("compute_s").alias("compute_s"), F.max("compute_s").alias("worst_s"), (F.max(F.col("compute_s") / fill) <= 1).alias("keeps_up"))


def watched(frames: DataFrame, *, name: str = "frames") -> DataFrame:
    """The stream, with what ST6 needs counted on the way (DataFrame.observe): no column and no second pass."""
    return frames.observe(name, F.count("*").alias("frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


class LiveMonitor(StreamingQueryListener):
    """ST6 live: a row for each micro-batch of a watched() stream: query, batch, frames, first and last event time, and its compute time.

    A batch's compute time is its trigger's, as Spark reports it. rows is bounded: the latest `keep` batches.
    """

    SCHEMA = "session string, batch long, frames long, first_ts timestamp, last_ts timestamp, compute_s double"

    def __init__(self, *, name: str = "frames", keep: int = 10_000):
        self.name, self.rows = name, deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is not None and seen["frames"]:
            self.rows.append((p.name or str(p.id), p.batchId, seen["frames"], seen["first_ts"], seen["last_ts"], p.durationMs["triggerExecution"] / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def timings(self, spark: SparkSession) -> DataFrame:
        """What buffer_monitor takes: each micro-batch as a buffer."""
        return spark.createDataFrame(list(self.rows), self.SCHEMA)
