"""Selecting beats, frames and anatomies; random choices are by md5 of seed and id, so that any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(seed: int, *ids) -> Column:
    """A reproducible random key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def complete_beats(df: DataFrame, *, fpb: int = 50) -> DataFrame:
    """anatomy_id, beat_id of beats with exactly the samples 0 to fpb - 1."""
    g = df.groupBy("anatomy_id", "beat_id").agg(F.count("*").alias("n"), F.countDistinct("sample_index").alias("d"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi"))
    return g.filter((F.col("n") == fpb) & (F.col("d") == fpb) & (F.col("lo") == 0) & (F.col("hi") == fpb - 1)).select("anatomy_id", "beat_id")


def first_complete_beat(df: DataFrame, *, fpb: int = 50, anatomy: int | None = None, beat: int | None = None) -> DataFrame:
    """Frames of the first complete beat: lowest anatomy, then beat; pinned if asked."""
    beats = complete_beats(df, fpb=fpb)
    if anatomy is not None:
        beats = beats.filter(F.col("anatomy_id") == anatomy)
    if beat is not None:
        beats = beats.filter(F.col("beat_id") == beat)
    one = beats.orderBy("anatomy_id", "beat_id").limit(1)
    return df.join(F.broadcast(one), ["anatomy_id", "beat_id"], "left_semi")


def consecutive_complete_beats(df: DataFrame, n: int = 3, *, fpb: int = 50) -> DataFrame:
    """Per anatomy the first n beats in a row that are all complete: anatomy_id, first_beat."""
    full = complete_beats(df, fpb=fpb).withColumn("full", F.lit(1))
    beats = df.select("anatomy_id", "beat_id").distinct().join(full, ["anatomy_id", "beat_id"], "left")
    w = Window.partitionBy("anatomy_id").orderBy("beat_id")
    run = F.sum(F.coalesce("full", F.lit(0))).over(w.rowsBetween(0, n - 1))
    return beats.withColumn("run", run).filter(F.col("run") == n).groupBy("anatomy_id").agg(F.min("beat_id").alias("first_beat"))


def split_ids(ids: DataFrame, sizes: dict[str, int], *, seed: int, column: str = "anatomy_id") -> DataFrame:
    """Disjoint splits of exact sizes over distinct ids; ids beyond them are in none. Works on the table of ids, not on frames."""
    order = ids.select(column).distinct().withColumn("_lot", lot(seed, column))
    ranked = order.orderBy("_lot", column).limit(sum(sizes.values())).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_lot", column)))
    bounds, at = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        bounds = F.when((F.col("_n") > at) & (F.col("_n") <= at + n), name).otherwise(bounds)
        at += n
    return ranked.select(column, bounds.alias("split"))


def position_split(df: DataFrame, fraction: float, *, order: str, by: list[str]) -> DataFrame:
    """train: the first int(fraction * n) rows of each group; the rest is validation."""
    w = Window.partitionBy(*by)
    n = F.row_number().over(w.orderBy(order))
    return df.withColumn("split", F.when(n <= F.floor(F.lit(fraction) * F.count("*").over(w)), "train").otherwise("validation"))


def stratified(df: DataFrame, k: int, *, by: str, unit: str, seed: int) -> DataFrame:
    """k units of each stratum, by lot."""
    u = df.select(by, unit).distinct()
    w = Window.partitionBy(by).orderBy(lot(seed, unit), unit)
    return u.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k)


def gallery(df: DataFrame, count: int, *, by: str, order: str) -> DataFrame:
    """One of each group first, then in order, up to count."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_n", (n > 1).cast("int")).orderBy("_n", order).limit(count).drop("_n")


def even_rows(df: DataFrame, limit: int, *, by: list[str], order: str) -> DataFrame:
    """Rows at floor(i * (n - 1) / (limit - 1)) of each group, each once; all rows when there are no more than limit."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1)
    at = F.floor(F.expr(f"(_i * {limit - 1} + _n - 2) div (_n - 1)") * (F.col("_n") - 1) / (limit - 1))
    chosen = (F.col("_n") <= limit) | ((at == F.col("_i")) & (F.expr(f"(_i * {limit - 1} + _n - 2) div (_n - 1)") <= limit - 1))
    return d.filter(chosen).drop("_n", "_i")


def head(df: DataFrame, n: int, *, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def phase_pick(df: DataFrame, k: int, *, by: list[str], value: str, order: str, seed: int) -> DataFrame:
    """k rows of each group: largest, smallest and nearest to zero, then by lot."""
    w = Window.partitionBy(*by)
    ranks = [F.row_number().over(w.orderBy(o, order)) for o in (F.desc(value), F.asc(value), F.abs(F.col(value)))]
    d = df
    for i, r in enumerate(ranks):
        d = d.withColumn(f"_r{i}", r)
    special = F.when(F.col("_r0") == 1, 0).when(F.col("_r1") == 1, 1).when(F.col("_r2") == 1, 2).otherwise(3)
    n = F.row_number().over(w.orderBy("_s", lot(seed, *by, order), order))
    return d.withColumn("_s", special).withColumn("_k", n).filter(F.col("_k") <= k).drop("_r0", "_r1", "_r2", "_s", "_k")


def nearest_phase(df: DataFrame, target, *, by: list[str], value: str, order: str, least: float) -> DataFrame:
    """Of each group the row whose value, at least `least`, is nearest to the target; the first on ties."""
    w = Window.partitionBy(*by).orderBy(F.abs(F.col(value) - target), order)
    return df.filter(F.col(value) >= least).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_and_worst(df: DataFrame, k: int, *, by: list[str], score: str, order: str, seed: int) -> DataFrame:
    """k rows by lot from the better half (lower score) and k from the rest, ranked in each pool by score."""
    w = Window.partitionBy(*by)
    half = F.row_number().over(w.orderBy(score, order)) <= F.expr("_n div 2")
    d = df.withColumn("_n", F.count("*").over(w)).withColumn("pool", F.when(half, "good").otherwise("bad")).drop("_n")
    pool = Window.partitionBy(*by, "pool")
    d = d.withColumn("_k", F.row_number().over(pool.orderBy(lot(seed, order), order))).filter(F.col("_k") <= k).drop("_k")
    return d.withColumn("pool_rank", F.row_number().over(pool.orderBy(score, order)))


def top_per_group(df: DataFrame, k: int, *, by: list[str], score, order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def visibility(frames: DataFrame, labels: DataFrame, coo: DataFrame, areas: DataFrame, *, side: int, lumen: int = 6, fpb: int = 50, least_peak: float = 0.01) -> DataFrame:
    """SE12: how visible the two largest lumens of each anatomy are in its first beat.

    frames: anatomy_id, beat_id, sample_index, sigma; labels: anatomy_id, row, col, label (the tissue grid);
    coo: the map from elements to pixels; areas: anatomy_id, least_area. The beat is the first, and must
    be whole; its peak is the frame of largest RMS. Lumens are the 8-neighbour components of the lumen's
    cells, larger ones first; a lumen's peak is the largest size of the peak frame's image inside it.
    Anatomies with fewer than two lumens, or with a peak below least_peak, have no row.
    """
    from beatframe.functions.arrays import rms
    from beatframe.operators.mesh import grid_labels, raster

    first = frames.groupBy("anatomy_id").agg(F.min("beat_id").alias("beat_id"))
    beat = frames.join(first, ["anatomy_id", "beat_id"])
    best = F.max_by(F.struct("sample_index", "sigma"), F.struct("_rms", -F.col("sample_index")))
    peak = beat.withColumn("_rms", rms("sigma")).groupBy("anatomy_id", "beat_id").agg(F.count("*").alias("_n"), best.alias("_p")).filter(F.col("_n") == fpb)
    peak = peak.select("anatomy_id", "beat_id", "_p.*")
    cells = grid_labels(labels.filter(F.col("label") == lumen), "anatomy_id").filter("rank <= 2")
    image = raster(coo, peak, ["anatomy_id"], "sigma", side=side).select("anatomy_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.abs("y").alias("y"))
    lumens = cells.join(image, ["anatomy_id", "row", "col"]).groupBy("anatomy_id", "rank").agg(F.first("size").alias("size"), F.first("row_mean").alias("r"), F.first("col_mean").alias("c"), F.max("y").alias("peak"))
    one, two = (lumens.filter(F.col("rank") == k).select("anatomy_id", *[F.col(c).alias(f"{c}{k}") for c in ("size", "r", "c", "peak")]) for k in (1, 2))
    j = one.join(two, "anatomy_id").join(peak.select("anatomy_id", "beat_id", "sample_index"), "anatomy_id").join(areas.select("anatomy_id", "least_area"), "anatomy_id")
    least, far = F.least("peak1", "peak2"), F.sqrt(F.pow(F.col("r1") - F.col("r2"), 2) + F.pow(F.col("c1") - F.col("c2"), 2))
    score = 100_000.0 * F.col("size2") * F.col("minimum_peak") + 100.0 * F.col("least_area") + 10.0 * F.col("centroid_distance")
    j = j.select("anatomy_id", "beat_id", (F.col("sample_index") + 1).alias("peak_sample"), F.col("size1").alias("lumen_1_pixels"), F.col("size2").alias("lumen_2_pixels"), far.alias("centroid_distance"), "least_area", least.alias("minimum_peak"), "size2")
    return j.filter(F.col("minimum_peak") >= least_peak).withColumn("score", score).drop("size2")


def best_median_worst(df: DataFrame, *, by: list[str], score: str, order: str) -> DataFrame:
    """The rows at ranks 1, n div 2 + 1 and n by score, named best, median and worst."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(score, order)))
    name = F.when(F.col("_r") == 1, "best").when(F.col("_r") == F.expr("_n div 2 + 1"), "median").when(F.col("_r") == F.col("_n"), "worst")
    return d.withColumn("place", name).filter("place is not null").drop("_n", "_r")


def match_rms(df: DataFrame, real: DataFrame, *, key: str, columns: list[str], rms: str, seed: int, low: float, high: float) -> DataFrame:
    """Scales columns of each row to the RMS of a real row drawn by lot (with replacement), the factor clipped to [low, high].

    real has columns i (0 to n - 1) and rms; its count is taken in the same job.
    """
    n = real.agg(F.count("*").alias("_n"))
    drawn = df.crossJoin(F.broadcast(n)).withColumn("i", F.pmod(F.conv(F.substring(lot(seed, key), 1, 8), 16, 10).cast("long"), F.col("_n")))
    d = drawn.join(real.select("i", F.col("rms").alias("_rms")), "i")
    factor = F.least(F.greatest(F.col("_rms") / F.greatest(F.col(rms), F.lit(1e-12)), F.lit(low)), F.lit(high))
    d = d.withColumn("factor", factor)
    for c in columns:
        d = d.withColumn(c, F.col(c) * F.col("factor"))
    return d.drop("_n", "_rms", "i")
