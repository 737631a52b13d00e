"""Aggregations and report roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.functions.arrays import finite, rms
from beatframe.functions.quantiles import exact_percentiles, summarised
from beatframe.operators.metrics import SUMS, error_metrics, frame_sums


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AG1."""
    return summarised(df, by, [F.avg(value).alias("mean"), F.max(value).alias("max")], {"median": (value, 0.5)}).select(*by, "mean", "median", "max")


def activation(df: DataFrame, vector: str, stage: str, *, reference: str) -> DataFrame:
    """AG2: per-frame RMS summarised by stage, and each stage's mean as a share of the reference stage's; null where there is none."""
    g = summary(df.withColumn("_rms", rms(vector)), "_rms", [stage])
    ref = g.filter(F.col(stage) == reference).select(F.col("mean").alias("_ref"))
    return g.join(F.broadcast(ref), F.lit(True), "left").withColumn("share", F.when(F.col("_ref").isNotNull(), F.col("mean") / F.greatest("_ref", F.lit(1e-30)))).drop("_ref")


def diagnostics(df: DataFrame, by: list[str], *, residual: str, step: str, clipped: str) -> DataFrame:
    """AG3."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(residual).alias("residual_mean"), F.max(residual).alias("residual_max"), F.avg(step).alias("step_mean"), F.sum(clipped).alias("clipped_total"))


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AG4."""
    of = [F.count("*").alias("count"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")]
    return summarised(df, by, of, {"median": (value, 0.5), "p95": (value, 0.95)}).select(*by, "count", "total", "mean", "median", "p95", "min", "max")


def throughput(df: DataFrame, seconds: str, frames: str, by: list[str], *, hz: float) -> DataFrame:
    """AG5, ST6: rates of timed chunks against a stream of `hz`.

    The budget of a chunk is the time its frames take to arrive; its fraction is the share of it that the
    chunk's computing takes: mean, p95 and largest over chunks. A chunk is delivered after it is filled
    (the largest chunk's frames at hz) and computed (mean). Rates over no time or no frames are null.
    """
    fraction = F.try_divide(F.col(seconds) * hz, F.col(frames))
    of = [F.sum(frames).alias("timed_frames"), F.sum(seconds).alias("s"), F.avg(seconds).alias("chunk_mean"), F.max(frames).alias("chunk"), F.avg(fraction).alias("budget_fraction"), F.max(fraction).alias("budget_fraction_max")]
    g = summarised(df, by, of, {"budget_fraction_p95": (fraction, 0.95)})
    hertz = F.try_divide("timed_frames", "s")
    return g.select(
        *by, "timed_frames", hertz.alias("effective_hz"), F.try_divide("s", "timed_frames").alias("per_frame"), (hertz >= hz).alias("meets"),
        "budget_fraction", "budget_fraction_p95", "budget_fraction_max", (F.col("budget_fraction_p95") <= 1).alias("p95_meets"), (F.col("budget_fraction_max") <= 1).alias("max_meets"),
        (F.col("chunk") / hz).alias("buffer_fill"), (F.col("chunk") / hz + F.col("chunk_mean")).alias("buffered_delivery"),
    )


def session_gate(df: DataFrame, *, start: str, seconds: str, frames: str, difference: str, limit_s: float = 900.0, per: int = 8000, parity: float = 1e-4) -> DataFrame:
    """AG6: one row for all sessions, which ran side by side: frames, the time from the first start (in seconds) to the last end, its rate, seconds for `per` frames, the worst parity, and whether both limits hold."""
    g = df.agg(F.count("*").alias("sessions"), F.sum(frames).alias("total_frames"), (F.max(F.col(start) + F.col(seconds)) - F.min(start)).alias("wall_s"), F.max(difference).alias("worst_parity"))
    needed = F.try_divide(F.col("wall_s") * per, F.col("total_frames"))
    return g.select("sessions", "total_frames", "wall_s", F.try_divide("total_frames", "wall_s").alias("frames_per_s"), needed.alias("scaled_s"), "worst_parity", F.coalesce((F.col("worst_parity") <= parity) & (needed <= limit_s), F.lit(False)).alias("passed"))


def metric_table(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form: keys, metric, value."""
    return df.unpivot(keys, metrics, "metric", "value")


def aggregate_metrics(df: DataFrame, keys: list[str], metrics: list[str], *, unit: str, units: int) -> DataFrame:
    """AG7: mean, sample deviation, median, min and max of each metric; complete says whether all units are there."""
    long, by = metric_table(df, [*keys, unit], metrics), [*keys, "metric"]
    of = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")]
    # apart, as beside a distinct count there would be a sketch for each unit
    seen = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg((F.countDistinct(unit) == units).alias("complete"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return summarised(long, by, of, {"median": ("value", 0.5)}).join(seen, on).select(*by, "mean", "std", "median", "min", "max", "complete")


def deltas(df: DataFrame, keys: list[str], *, version: str, value: str, baseline: str) -> DataFrame:
    """AG8: candidate minus baseline, absolute and in percent (NaN on a zero baseline)."""
    base = df.filter(F.col(version) == baseline).select(*keys, F.col(value).alias("_b"))
    j = df.filter(F.col(version) != baseline).join(base, keys)
    d = F.col(value) - F.col("_b")
    return j.select(*keys, version, d.alias("delta"), F.when(F.col("_b") == 0, float("nan")).otherwise(100 * d / F.when(F.col("_b") != 0, F.abs("_b"))).alias("percent"))


def best_epoch(df: DataFrame, by: list[str], *, score: str, epoch: str) -> DataFrame:
    """AG9: the first epoch of least score, and how many ran."""
    g = df.groupBy(*by).agg(F.min(F.struct(F.col(score).alias("s"), F.col(epoch).alias("e"))).alias("m"), F.count("*").alias("epochs_run"))
    return g.select(*by, F.col("m.e").alias(epoch), F.col("m.s").alias(score), "epochs_run")


def training_tables(reports: DataFrame, key: str) -> dict[str, DataFrame]:
    """AG10: settings, epochs, selected epochs, physics and hashes of nested training reports (history: stages of epochs)."""
    stages = reports.select(key, F.posexplode("history").alias("stage", "epochs"))
    epochs = stages.select(key, "stage", F.posexplode("epochs").alias("epoch_order", "e")).select(key, "stage", "epoch_order", "e.*")
    return {
        "settings": reports.select(key, "settings.*"),
        "epochs": epochs,
        "selected": best_epoch(epochs, [key, "stage"], score="composite_score", epoch="epoch_order"),
        "physics": reports.select(key, F.explode("physics").alias("name", "value")),
        "hashes": reports.select(key, F.explode("hashes").alias("name", "value")),
    }


def comparison_table(reports: DataFrame, key: str, stages: str) -> DataFrame:
    """AG11, AG12: one row for each experiment and stage of nested evaluation reports, metrics as columns."""
    return reports.select(key, F.explode(stages).alias("s")).select(key, "s.stage", "s.metrics.*")


def scale_fit(df: DataFrame, vector: str, signal: str, *, split: str, train: str = "train") -> DataFrame:
    """AG13: scales from the train split: p99.5 of |x| over all and over nonzero values, its maximum, p99.5 of |signal|, the median frame RMS; with floors."""
    d = df.filter(F.col(split) == train)
    x, y = (d.select(F.explode(F.transform(c, F.abs)).alias("x")) for c in (vector, signal))
    parts = [
        exact_percentiles(x, [], "x", {"all_p995": 0.995}), exact_percentiles(x.filter("x > 0"), [], "x", {"nonzero_p995": 0.995}), exact_percentiles(y, [], "x", {"signal_p995": 0.995}),
        exact_percentiles(d, [], rms(vector), {"median_rms": 0.5}),
    ]
    j = d.agg(F.max(F.array_max(F.transform(vector, F.abs))).alias("maximum"))
    for p in parts:
        j = j.join(p, how="left", on=F.lit(True))  # one row at most each
    return j.select(*[F.greatest(n, F.lit(1e-6)).alias(n) for n in ("all_p995", "nonzero_p995", "maximum")], F.greatest("signal_p995", F.lit(1e-12)).alias("signal_p995"), F.greatest("median_rms", F.lit(1e-12)).alias("median_rms"))


def beat_quality(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """AG14: frames, NRMSE and correlation of each beat, over the values of all its frames."""
    sums = frame_sums(df, pred, truth)
    g = sums.groupBy(*by).agg(F.count("*").alias("frames"), *[F.sum(c).alias(c) for c in SUMS])
    return error_metrics(g).select(*by, "frames", "nrmse", "correlation")


def waveforms(df: DataFrame, by: list[str], order: str, pred: str = "pred", truth: str = "truth") -> DataFrame:
    return df.select(*by, order, rms(truth).alias("truth_rms"), rms(pred).alias("prediction_rms"))


def weakest(df: DataFrame, value: str, *, by: list[str], unit: str) -> DataFrame:
    """AG15: least RMS of a unit, by group; the least unit on ties."""
    u = df.groupBy(*by, unit).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return u.groupBy(*by).agg(F.min(F.struct("rms", unit)).alias("m")).select(*by, f"m.{unit}", "m.rms")


def coverage(df: DataFrame, audit: DataFrame, *, signal: str, channel: str, value: str, ratio: tuple[float, float], negative: tuple[float, float]) -> DataFrame:
    """AG16: each channel's RMS and q01 to q99 span, their medians over channels as ratios to the audit's (signal, rms, span), the negative share, and whether all are in range."""
    v = F.col(value)
    of = [F.sqrt(F.avg(v * v)).alias("rms"), F.sum((v < 0).cast("long")).alias("neg"), F.count("*").alias("n")]
    c = summarised(df, [signal, channel], of, {"_low": (value, 0.01), "_high": (value, 0.99)}).withColumn("span", F.col("_high") - F.col("_low"))
    g = c.groupBy(signal).agg(F.percentile("rms", 0.5).alias("rms"), F.percentile("span", 0.5).alias("span"), (F.sum("neg") / F.sum("n")).alias("negative_fraction"), F.count("*").alias("channels"))
    j = g.join(audit.select(signal, F.col("rms").alias("_r"), F.col("span").alias("_s")), signal)
    a, b = F.col("rms") / F.greatest("_r", F.lit(1e-30)), F.col("span") / F.greatest("_s", F.lit(1e-30))
    ok = a.between(*ratio) & b.between(*ratio) & F.col("negative_fraction").between(*negative)
    return j.select(signal, "channels", a.alias("rms_ratio"), b.alias("span_ratio"), "negative_fraction", ok.alias("passed"))


def linearisation_gate(df: DataFrame, by: list[str], *, unit: str, exact: str, linear: str, error: float = 0.50, correlation: float = 0.80) -> DataFrame:
    """AG17: relative L2 and correlation of each unit; their mean and worst against limits."""
    x, y = F.col(exact), F.col(linear)
    u = df.groupBy(*by, unit).agg(F.sum(F.pow(y - x, 2)).alias("e"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.count("*").cast("double").alias("n"))
    rel = F.sqrt("e") / F.greatest(F.sqrt("xx"), F.lit(1e-12))
    vx, vy = F.col("xx") / F.col("n") - F.pow(F.col("x") / F.col("n"), 2), F.col("yy") / F.col("n") - F.pow(F.col("y") / F.col("n"), 2)
    r = F.when((vx > 1e-30) & (vy > 1e-30), (F.col("xy") / F.col("n") - F.col("x") * F.col("y") / F.pow("n", F.lit(2))) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300)))).otherwise(0.0)
    g = u.select(*by, rel.alias("rel"), r.alias("r")).groupBy(*by).agg(F.avg("rel").alias("mean_error"), F.max("rel").alias("max_error"), F.avg("r").alias("mean_correlation"), F.min("r").alias("min_correlation"))
    return g.withColumn("passed", (F.col("mean_error") <= error) & (F.col("mean_correlation") >= correlation))


def display_limit(df: DataFrame, value: str, by: list[str], q: float = 0.995) -> DataFrame:
    """AG18: a symmetric limit, max(q-quantile of |finite|, 1e-8), and two-sided 0.5 % limits; groups without a finite value give no row."""
    d = df.filter(finite(value))
    return summarised(d, by, [], {"low": (value, 0.005), "high": (value, 0.995), "limit": (F.abs(F.col(value)), q)}).select(*by, F.greatest("limit", F.lit(1e-8)).alias("limit"), "low", "high")


def channel_scale(df: DataFrame, *, channel: str, value: str, shared: list[int]) -> DataFrame:
    """AG19: largest |value| of each channel; the shared channels have one scale."""
    g = df.groupBy(channel).agg(F.max(F.abs(F.col(value))).alias("scale"))
    inside = F.col(channel).isin(shared)
    return g.withColumn("scale", F.when(inside, F.max("scale").over(Window.partitionBy(inside))).otherwise(F.col("scale")))


def chosen_stage(*residuals: str) -> Column:
    """AG20: index of the least residual, the first on ties."""
    a = F.array(*[F.col(r) for r in residuals])
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def stage_fractions(df: DataFrame, by: list[str], residuals: list[str]) -> DataFrame:
    """AG20: share of each stage, of frames whose last stage beats the first, and the mean ratio of the chosen to the first residual."""
    d = df.withColumn("_c", chosen_stage(*residuals)).withColumn("_best", F.least(*residuals))
    shares = [F.avg((F.col("_c") == i).cast("double")).alias(f"share_{r}") for i, r in enumerate(residuals)]
    return d.groupBy(*by).agg(*shares, F.avg((F.col(residuals[-1]) < F.col(residuals[0])).cast("double")).alias("accepted"), (F.avg("_best") / F.greatest(F.avg(residuals[0]), F.lit(1e-30))).alias("chosen_to_first"))


#: Metric, and whether the candidate is better when it is lower (-1), higher (1) or nearer to one (0).
COMPARISONS = (("element_nrmse", -1), ("image_correlation", 1), ("localisation_dice", 1), ("sign_accuracy", 1), ("rms_ratio", 0), ("frame_difference_rms_ratio", 0), ("voltage_residual", -1))


def classify(candidates: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """AG21: a candidate against its baseline: better_<metric> and delta_<metric> of seven comparisons, the wins, and the class.

    finite and sane say whether all image metrics are finite and both ratios lie in 0.05 to 20; a candidate
    that is not both has failed, one of four wins or more is promising, another exploratory. A comparison
    with NaN is not won.
    """
    j = candidates.join(baseline.select(*keys, *[F.col(m).alias(f"_{m}") for m, _ in COMPARISONS]), keys)
    wins, ok = F.lit(0), F.lit(True)
    for m, way in COMPARISONS:
        a, b = F.col(m), F.col(f"_{m}")
        better = F.abs(a - 1) < F.abs(b - 1) if way == 0 else a < b if way < 0 else a > b
        won = F.coalesce(better & ~F.isnan(a) & ~F.isnan(b), F.lit(False))
        j = j.withColumn(f"better_{m}", won).withColumn(f"delta_{m}", a - b)
        wins = wins + won.cast("int")
        if m != "voltage_residual":
            ok = ok & finite(m)
    between = F.coalesce(F.col("rms_ratio").between(0.05, 20.0) & F.col("frame_difference_rms_ratio").between(0.05, 20.0), F.lit(False))
    j = j.withColumn("finite", ok).withColumn("sane", between).withColumn("improvements", wins)
    j = j.withColumn("class", F.when(~(F.col("finite") & F.col("sane")), "failed").when(F.col("improvements") >= 4, "promising").otherwise("exploratory"))
    return j.drop(*[f"_{m}" for m, _ in COMPARISONS])
