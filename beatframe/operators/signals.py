"""Windowed signal decomposition. A recording is a partition (by), frames are its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_mean(column, *, by: list[str], order: str, window: int = 100) -> Column:
    """Centered mean; an even window takes window // 2 frames before and one fewer after, and ends shrink."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(window // 2), window - window // 2 - 1)
    return F.avg(column).over(w)


def hp_lp(df: DataFrame, column: str = "x", *, by: list[str], order: str, window: int = 100) -> DataFrame:
    """lp: the moving mean; hp: what it leaves."""
    return df.withColumn("lp", moving_mean(column, by=by, order=order, window=window)).withColumn("hp", F.col(column) - F.col("lp"))


def at_frame(column, *, by: list[str], order: str, k: int = 0) -> Column:
    """The partition's value at frame k, on each of its rows; null where there is no such frame."""
    return F.max(F.when(F.col(order) == k, F.col(column))).over(Window.partitionBy(*by))


def component_reference(df: DataFrame, columns: list[str], *, by: list[str], order: str, k: int = 0) -> DataFrame:
    """Columns minus their values at frame k."""
    for c in columns:
        df = df.withColumn(c, F.col(c) - at_frame(c, by=by, order=order, k=k))
    return df


def referenced_hp_lp(df: DataFrame, column: str = "x", *, by: list[str], order: str, window: int = 100, k: int = 0) -> DataFrame:
    """hp and lp, both referenced to frame k, so that hp + lp = x - x[k]."""
    return component_reference(hp_lp(df, column, by=by, order=order, window=window), ["hp", "lp"], by=by, order=order, k=k)


def centered_difference(column, *, by: list[str], order: str) -> Column:
    """(next - previous) / 2; zero at both ends."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.coalesce((F.lead(column).over(w) - F.lag(column).over(w)) / 2, F.lit(0.0))


def second_difference(df: DataFrame, column: str, *, by: list[str], order: str) -> DataFrame:
    """d and dd: the centered difference and its own."""
    d = df.withColumn("d", centered_difference(column, by=by, order=order))
    return d.withColumn("dd", centered_difference("d", by=by, order=order))


def decompose_and_retain(df: DataFrame, column: str = "x", *, by: list[str], order: str, window: int = 100, pad: int = 50, keep: int = 250) -> DataFrame:
    """Components full, hp and lp of each recording, decomposed whole and cropped only then; frame 0 is the first kept one.

    Cropping first would leak the ends into the moving mean. hp and lp are referenced to the first kept frame.
    """
    d = referenced_hp_lp(df, column, by=by, order=order, window=window, k=pad).filter(F.col(order).between(pad, pad + keep - 1))
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).alias("value")) for n, c in (("full", column), ("hp", "hp"), ("lp", "lp"))]))
    return d.select(*by, (F.col(order) - pad).alias(order), parts.alias("p")).select(*by, order, "p.component", "p.value")


def frame_steps(df: DataFrame, column: str, *, order: str, scope: list[str] | None = None) -> DataFrame:
    """Squared step to the next frame of the pack, across beats and anatomies; with scope (columns, such as a beat's), to the next frame of the same scope alone. A self-join, as one window over all rows would go through one task."""
    after = df.select(*(scope or []), (F.col(order) - 1).alias(order), F.col(column).alias("after"))
    return df.join(after, [*(scope or []), order]).withColumn("step2", F.pow(F.col("after") - F.col(column), 2)).drop("after")


def delta_to_first(df: DataFrame, column: str, *, order: str) -> DataFrame:
    """Column minus its value in the pack's first frame, which is one row."""
    first = df.agg(F.min_by(column, order).alias("first"))
    return df.crossJoin(F.broadcast(first)).withColumn("delta", F.col(column) - F.col("first")).drop("first")


def peak_sample(df: DataFrame, score: str, *, by: list[str], order: str) -> DataFrame:
    """The row of each group with the highest score, the first on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def consecutive_periods(df: DataFrame, *, by: list[str], period: str, order: str, n: int) -> DataFrame:
    """First run of n periods, each one more than the last, in the order in which they appear: by, start."""
    seen = df.groupBy(*by, period).agg(F.min(order).alias("_at"))
    w = Window.partitionBy(*by).orderBy("_at")
    steps = seen.withColumn("_step", (F.lead(period).over(w) - F.col(period) == 1).cast("int"))
    run = F.sum("_step").over(w.rowsBetween(0, n - 2)) if n > 1 else F.lit(0)
    fits = steps.withColumn("_run", F.coalesce(run, F.lit(0))).filter(F.col("_run") == n - 1)
    return fits.groupBy(*by).agg(F.min_by(period, "_at").alias("start"))


def phase_rank(df: DataFrame, *, by: list[str], phase: str) -> DataFrame:
    """Frames numbered from 0 inside a period, by phase."""
    return df.withColumn("phase_index", F.row_number().over(Window.partitionBy(*by).orderBy(phase)) - 1)


def residual_frames(df: DataFrame, *, by: list[str], order: str, stride: int) -> DataFrame:
    """Every stride-th frame, and the last."""
    last = F.max(order).over(Window.partitionBy(*by))
    return df.withColumn("_last", last).filter((F.col(order) % stride == 0) | (F.col(order) == F.col("_last"))).drop("_last")


def tumbling(order, size: int = 50) -> Column:
    """Number of the buffer that a frame falls in."""
    return F.floor(F.col(order) / size)


def reference_epochs(df: DataFrame, *, by: list[str], order: str, reset: str, column: str = "x", size: int = 250) -> DataFrame:
    """epoch, reference and delta: a new reference frame after every reset and every `size` frames; a gap in the order resets too."""
    w = Window.partitionBy(*by).orderBy(order)
    gap = F.coalesce(F.col(order) - F.lag(order).over(w) != 1, F.lit(True))
    df = df.withColumn("_reset", (F.col(reset) | gap).cast("int")).withColumn("_part", F.sum("_reset").over(w))
    inside = Window.partitionBy(*by, "_part").orderBy(order)
    df = df.withColumn("_epoch", F.floor((F.row_number().over(inside) - 1) / size))
    epoch = Window.partitionBy(*by, "_part", "_epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("reference", F.first(column).over(epoch))
    return df.withColumn("delta", F.col(column) - F.col("reference")).withColumn("epoch", F.concat_ws("-", F.col("_part"), F.col("_epoch"))).drop("_reset", "_part", "_epoch")
