"""Reconstruction metrics of a prediction against the truth.

Every pooled metric comes from one pass of per-frame sums (count, sums, squares, product, errors), which
then only add up; no element is exploded but where a metric needs its own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatframe.functions.arrays import TINY, sum_of, sum_of_two
from beatframe.functions.quantiles import summarised

NAN = float("nan")
SUMS = ("n", "sp", "st", "spp", "stt", "spt", "sae", "sse")


def frame_sums(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Adds the sums of each frame."""
    return (
        df.withColumn("n", F.size(pred).cast("double"))
        .withColumn("sp", sum_of(pred, lambda x: x)).withColumn("st", sum_of(truth, lambda x: x))
        .withColumn("spp", sum_of(pred, lambda x: x * x)).withColumn("stt", sum_of(truth, lambda x: x * x))
        .withColumn("spt", sum_of_two(pred, truth, lambda p, t: p * t))
        .withColumn("sae", sum_of_two(pred, truth, lambda p, t: F.abs(p - t)))
        .withColumn("sse", sum_of_two(pred, truth, lambda p, t: (p - t) * (p - t)))
    )


def pooled(sums: DataFrame, by: list[str]) -> DataFrame:
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def correlation(degenerate: float = NAN, floor: float = 1e-15) -> Column:
    """From the sums; `degenerate` where either side's standard deviation is below the floor."""
    c = F.col
    vp, vt = c("spp") / c("n") - F.pow(c("sp") / c("n"), 2), c("stt") / c("n") - F.pow(c("st") / c("n"), 2)
    sd = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    cov = c("spt") / c("n") - c("sp") * c("st") / (c("n") * c("n"))
    return F.when((sd(vp) < floor) | (sd(vt) < floor), degenerate).otherwise(cov / F.greatest(sd(vp) * sd(vt), F.lit(1e-300)))


def error_metrics(sums: DataFrame) -> DataFrame:
    """ME1: rmse, nrmse, mae, mse, the two RMS and their ratio; ME2: correlation."""
    c = F.col
    truth_rms = F.greatest(F.sqrt(c("stt") / c("n")), F.lit(TINY))
    pred_rms = F.sqrt(c("spp") / c("n"))
    rmse = F.sqrt(c("sse") / c("n"))
    out = {"rmse": rmse, "nrmse": rmse / truth_rms, "mae": c("sae") / c("n"), "mse": c("sse") / c("n"), "prediction_rms": pred_rms, "truth_rms": truth_rms, "rms_ratio": pred_rms / truth_rms, "correlation": correlation()}
    return sums.select(*[x for x in sums.columns if x not in SUMS], *[v.alias(k) for k, v in out.items()])


def frame_correlations(sums: DataFrame, by: list[str]) -> DataFrame:
    """ME3: mean and median over frames that have a correlation."""
    d = sums.withColumn("r", correlation()).filter(~F.isnan("r"))
    return summarised(d, by, [F.avg("r").alias("mean"), F.count("*").alias("frames")], {"median": ("r", 0.5)}).select(*by, "mean", "median", "frames")


def jointly_finite(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """ME4: both vectors without the places where either is not finite."""
    ok = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    both = F.filter(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("t")), lambda z: ok(z["p"]) & ok(z["t"]))
    return df.withColumn("_both", both).withColumn(pred, F.transform("_both", lambda z: z["p"])).withColumn(truth, F.transform("_both", lambda z: z["t"])).drop("_both")


def top_k_indices(vector, k: Column) -> Column:
    """SE15: indices of the k largest absolute values, the least index on ties."""
    ranked = F.array_sort(F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def support(vector, floor: float = 1e-8) -> Column:
    marked = F.transform(vector, lambda x, i: F.when(F.abs(x) > floor, i))
    return F.filter(marked, lambda i: i.isNotNull())


def localisation_dice(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """ME5: overlap of the truth's support with as many places of largest prediction; frames without support are left out."""
    d = df.withColumn("_s", support(truth)).filter(F.size("_s") > 0)
    hit = F.size(F.array_intersect("_s", top_k_indices(pred, F.size("_s"))))
    return d.withColumn("dice", hit / F.size("_s")).drop("_s")


def support_metrics(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth", floor: float = 1e-8) -> DataFrame:
    """ME7: sign accuracy and mean on the support, RMS on the background; NaN where there is none."""
    z = F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("t"))
    on, off = F.filter(z, lambda e: F.abs(e["t"]) > floor), F.filter(z, lambda e: F.abs(e["t"]) <= floor)
    add = lambda a, f: F.sum(F.aggregate(a, F.lit(0.0), lambda s, e: s + f(e)))
    g = df.withColumn("_on", on).withColumn("_off", off).groupBy(*by).agg(
        F.sum(F.size("_on")).alias("_n"), F.sum(F.size("_off")).alias("_m"), add("_on", lambda e: (F.signum(e["p"]) == F.signum(e["t"])).cast("double")).alias("_s"),
        add("_off", lambda e: e["p"] * e["p"]).alias("_b"), add("_on", lambda e: e["p"]).alias("_v"),
    )
    part = lambda top, n: F.when(F.col(n) > 0, F.col(top) / F.greatest(F.col(n), F.lit(1))).otherwise(NAN)
    return g.select(*by, part("_s", "_n").alias("sign_accuracy"), F.sqrt(part("_b", "_m")).alias("background_rms"), part("_v", "_n").alias("support_mean"))


def dynamics(df: DataFrame, *, order: str, pred: str = "pred", truth: str = "truth", scope: list[str] | None = None) -> DataFrame:
    """ME8: RMS of steps between following frames of the pack, and their ratio; by self-join on order + 1. With scope, frames of the same scope alone (columns, such as a beat's)."""
    after = df.select(*(scope or []), (F.col(order) - 1).alias(order), F.col(pred).alias("_p"), F.col(truth).alias("_t"))
    j = df.join(after, [*(scope or []), order])
    sq = lambda a, b: F.sum(sum_of_two(a, b, lambda x, y: (y - x) * (y - x)))
    g = j.agg(sq(pred, "_p").alias("p"), sq(truth, "_t").alias("t"), F.sum(F.size(pred)).alias("n"))
    p, t = F.sqrt(F.col("p") / F.col("n")), F.greatest(F.sqrt(F.col("t") / F.col("n")), F.lit(TINY))
    return g.select(p.alias("frame_difference_rms"), t.alias("truth_frame_difference_rms"), (p / t).alias("frame_difference_rms_ratio"))


def dynamic_set(df: DataFrame, by: list[str], *, order: str) -> DataFrame:
    """ME9: absolute metrics of pred against truth; dynamic ones, both taken against resting, with the median of the frames' correlations; temporal ones, both taken against their first frame; and how many predicted values are not positive."""
    first = df.groupBy(*by).agg(F.min_by("pred", order).alias("_p0"), F.min_by("truth", order).alias("_t0"))
    d = df.join(first, by)
    less = lambda v, w: F.zip_with(v, w, lambda x, r: x - r)
    sets = {"absolute": ("pred", "truth"), "dynamic": (less("pred", "resting"), less("truth", "resting")), "temporal_delta": (less("pred", "_p0"), less("truth", "_t0"))}
    names = {"absolute": ("rmse", "correlation"), "dynamic": ("rmse", "nrmse", "correlation", "rms_ratio"), "temporal_delta": ("nrmse", "correlation", "rms_ratio")}
    out = df.groupBy(*by).agg(F.sum(F.size(F.filter("pred", lambda x: x <= 0))).alias("nonpositive"))
    for name, (p, t) in sets.items():
        sums = frame_sums(d.select(*by, (F.col(p) if isinstance(p, str) else p).alias("pred"), (F.col(t) if isinstance(t, str) else t).alias("truth")))
        out = out.join(error_metrics(pooled(sums, by)).select(*by, *[F.col(m).alias(f"{name}_{m}") for m in names[name]]), by)
        if name == "dynamic":
            r = summarised(sums.withColumn("r", correlation()), by, [F.count("*").alias("_n")], {"dynamic_frame_correlation_median": (F.nanvl("r", F.lit(None)), 0.5)})
            out = out.join(r.drop("_n"), by)
    return out


def relative_errors(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """ME10: relative L1 and L2 error of each frame; where the truth is zero, the absolute error."""
    ratio = lambda e, n: F.when(n > 0, e / F.greatest(n, F.lit(1e-300))).otherwise(e)
    l1 = ratio(sum_of_two(pred, truth, lambda p, t: F.abs(p - t)), sum_of(truth, F.abs))
    l2 = ratio(F.sqrt(sum_of_two(pred, truth, lambda p, t: (p - t) * (p - t))), F.sqrt(sum_of(truth, lambda t: t * t)))
    return df.withColumn("re_l1", l1).withColumn("re_l2", l2)


def parity(df: DataFrame, by: list[str], candidate: str = "pred", reference: str = "truth", *, relative: float = 1e-6, absolute: float = 1e-7) -> DataFrame:
    """ME11: relative L2, largest and mean absolute difference, and whether both limits hold."""
    biggest = F.array_max(F.zip_with(candidate, reference, lambda a, b: F.abs(a - b)))
    g = frame_sums(df, candidate, reference).withColumn("_m", biggest).groupBy(*by).agg(F.sum("sse").alias("e"), F.sum("stt").alias("t"), F.sum("sae").alias("a"), F.sum("n").alias("n"), F.max("_m").alias("max_abs"))
    rel = F.sqrt("e") / F.greatest(F.sqrt("t"), F.lit(TINY))
    return g.select(*by, rel.alias("relative_l2"), "max_abs", (F.col("a") / F.col("n")).alias("mean_abs"), ((rel <= relative) & (F.col("max_abs") <= absolute)).alias("passed"))


def checkpoint_score(df: DataFrame, by: list[str], *, background: float, dice: float) -> DataFrame:
    """ME12: nrmse + background * background RMS - dice * mean Dice."""
    e = error_metrics(pooled(frame_sums(df), by)).select(*by, "nrmse")
    s = support_metrics(df, by).select(*by, "background_rms")
    d = localisation_dice(df).groupBy(*by).agg(F.avg("dice").alias("dice"))
    j = e.join(s, by).join(d, by, "left")
    return j.select(*by, (F.col("nrmse") + background * F.nanvl("background_rms", F.lit(0.0)) - dice * F.coalesce("dice", F.lit(0.0))).alias("score"))


def distillation(df: DataFrame, by: list[str], *, trial: str, held_out: str) -> DataFrame:
    """ME13: mse, mae, correlation, the zero prediction's mse, and the held-out trials."""
    m = error_metrics(pooled(frame_sums(df), by)).select(*by, "mse", "mae", "correlation", (F.col("truth_rms") * F.col("truth_rms")).alias("zero_mse"))
    return m.join(df.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(F.col(held_out), F.col(trial)))).alias("held_out_trials")), by)


def negative_mass(df: DataFrame, by: list[str], vector: str = "pred") -> DataFrame:
    """ME14: share of absolute mass that is negative."""
    g = df.groupBy(*by).agg(F.sum(sum_of(vector, lambda x: F.greatest(-x, F.lit(0.0)))).alias("a"), F.sum(sum_of(vector, F.abs)).alias("b"))
    return g.select(*by, (F.col("a") / F.greatest("b", F.lit(1e-30))).alias("negative_mass"))


def object_metrics(df: DataFrame, by: list[str], positions: DataFrame, *, muscle: int = 3) -> DataFrame:
    """ME6: how well the field shows its two vessels, over frames with pred, truth and tissue (arrays in the order of elem_id), vessels (x, y, axis_a, axis_b, angle) and centres (x, y: the predicted ones).

    A vessel's core is its ellipse. Of each frame: the overlap (Dice) of the cores with as many places of
    largest prediction; the mean distance of centres in the better of both matchings; each vessel's
    difference of means inside its core. Over all frames: RMSE in muscle outside the cores (the halo), the
    prediction's RMS outside both, and the median ratio of absolute masses. positions (elem_id, x, y) are one
    mesh's. Frames without a core have no Dice; where nothing is measured, zero.
    """
    from beatframe.operators.mesh import mesh_points

    points = mesh_points(positions)

    def holds(p, v):
        dx, dy = p["x"] - v["x"], p["y"] - v["y"]
        u, w = F.cos(v["angle"]) * dx + F.sin(v["angle"]) * dy, F.cos(v["angle"]) * dy - F.sin(v["angle"]) * dx
        return F.pow(u / F.greatest(v["axis_a"], F.lit(1e-5)), 2) + F.pow(w / F.greatest(v["axis_b"], F.lit(1e-5)), 2) <= 1

    far = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    p, q, t, u = F.col("centres")[0], F.col("centres")[1], F.col("vessels")[0], F.col("vessels")[1]
    centre = F.least((far(p, t) + far(q, u)) / 2, (far(p, u) + far(q, t)) / 2)
    d = df.crossJoin(F.broadcast(points)).select(
        *by, "pred", "truth", "tissue", centre.alias("centre"), F.transform("_points", lambda x: holds(x, t)).alias("_m0"), F.transform("_points", lambda x: holds(x, u)).alias("_m1")
    )
    d = d.withColumn("_core", F.zip_with("_m0", "_m1", lambda a, b: a | b)).withColumn("_places", F.filter(F.transform("_core", lambda c, i: F.when(c, i)), lambda i: i.isNotNull()))
    n = F.size("_places")
    d = d.withColumn("dice", F.when(n > 0, F.try_divide(F.size(F.array_intersect("_places", top_k_indices("pred", n))), n)))
    z = F.arrays_zip("pred", "truth", "tissue", F.col("_core").alias("core"), F.col("_m0").alias("m0"), F.col("_m1").alias("m1"))
    add = lambda keep, f: F.aggregate(F.filter("_z", keep), F.lit(0.0), lambda s, e: s + f(e))
    many = lambda keep: F.size(F.filter("_z", keep))
    halo, outside = (lambda e: (e["tissue"] == muscle) & ~e["core"]), (lambda e: (e["tissue"] != muscle) & ~e["core"])
    apart = lambda m: F.abs(F.try_divide(add(lambda e: e[m], lambda e: e["pred"]) - add(lambda e: e[m], lambda e: e["truth"]), many(lambda e: e[m])))
    mass = add(lambda e: F.lit(True), lambda e: F.abs(e["truth"]))
    d = d.withColumn("_z", z).select(
        *by, "dice", "centre", apart("m0").alias("a0"), apart("m1").alias("a1"), add(halo, lambda e: F.pow(e["pred"] - e["truth"], 2)).alias("h"), many(halo).alias("hn"),
        add(outside, lambda e: e["pred"] * e["pred"]).alias("o"), many(outside).alias("on"), F.when(mass > 1e-10, F.try_divide(add(lambda e: F.lit(True), lambda e: F.abs(e["pred"])), mass)).alias("ratio"),
    )
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    of = [
        or_zero(F.avg("dice")).alias("core_dice"), F.avg("centre").alias("centre_error"), F.try_divide(F.coalesce(F.sum("a0"), F.lit(0.0)) + F.coalesce(F.sum("a1"), F.lit(0.0)), F.count("a0") + F.count("a1")).alias("amplitude_mae"),
        or_zero(F.sqrt(F.try_divide(F.sum("h"), F.sum("hn")))).alias("halo_rmse"), or_zero(F.sqrt(F.try_divide(F.sum("o"), F.sum("on")))).alias("outside_rms"),
    ]
    return summarised(d, by, of, {"mass_ratio_median": ("ratio", 0.5)}).withColumn("mass_ratio_median", or_zero(F.col("mass_ratio_median")))
