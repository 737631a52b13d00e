"""Joins and lookups on frame keys, registries and geometry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.functions.arrays import close, plus
from beatframe.functions.tables import stored


def add_components(hp: DataFrame, lp: DataFrame, keys: list[str], vectors: list[str]) -> DataFrame:
    """JN1: the full view of two components, field by field hp + lp."""
    j = hp.join(lp.select(*keys, *[F.col(v).alias(f"_{v}") for v in vectors]), keys)
    for v in vectors:
        j = j.withColumn(v, plus(v, f"_{v}"))
    return j.drop(*[f"_{v}" for v in vectors])


def registry(sessions: DataFrame, rings: DataFrame, assets: DataFrame, *, subject: str, ring: str) -> DataFrame:
    """JN2: each session with its ring and whether its assets are there; exclusion_reason is null for records."""
    j = sessions.join(rings, subject, "left").join(assets.select(ring, F.lit(True).alias("_present")), ring, "left")
    reason = F.when(F.col(ring).isNull(), "no ring size").when(F.col("_present").isNull(), "no assets for ring")
    return j.withColumn("exclusion_reason", reason).drop("_present")


def source_order(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    return df.withColumn("source_order", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def selection(chosen: DataFrame, records: DataFrame, keys: list[str], *, start: str, n: int) -> DataFrame:
    """JN3: chosen rows with their records and the periods start to start + n - 1."""
    return chosen.join(records, keys).withColumn("periods", F.sequence(F.col(start), F.col(start) + n - 1))


def paired(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """JN4: both exports by key; status is a_only, b_only, mismatch or match; mismatch_<column> says where."""
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b")), keys, "full")
    both, differs = F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(False)
    for c in columns:
        j = j.withColumn(f"mismatch_{c}", both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
        differs = differs | F.col(f"mismatch_{c}")
    return j.withColumn("status", F.when(F.col("_b").isNull(), "a_only").when(F.col("_a").isNull(), "b_only").when(differs, "mismatch").otherwise("match")).drop("_a", "_b")


def vessel_areas(frames: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """JN5: frames with areas and the least one, from side records in either of two layouts: a model with arteries, whose lumen is a share of their radii, or vessels with semi-axes."""
    lumen = F.transform("model.arteries", lambda v: v["radius_x_mm"] * v["radius_y_mm"] * v["lumen_fraction"] * v["lumen_fraction"] * math.pi)
    plain = F.transform("vessels", lambda v: v["axis_a"] * v["axis_b"] * math.pi)
    s = side.select(key, F.when(F.col("model").isNotNull(), lumen).otherwise(plain).alias("areas")).withColumn("least_area", F.array_min("areas"))
    return frames.join(s, key)


def aligned(a: DataFrame, b: DataFrame, keys: list[str], truth: str, control: str, *, atol: float = 1e-7) -> DataFrame:
    """JN6: frames of two runs by key, and whether truth and control agree."""
    j = a.select(*keys, F.col(truth).alias("_t"), F.col(control).alias("_c"), F.lit(1).alias("_a")).join(b.select(*keys, F.col(truth).alias("_u"), F.col(control).alias("_d"), F.lit(1).alias("_b")), keys, "full")
    same = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: close(p, q, 0.0, atol)), lambda ok: F.coalesce(ok, F.lit(False)))
    return j.select(*keys, (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"), F.coalesce(same("_t", "_u"), F.lit(False)).alias("same_truth"), F.coalesce(same("_c", "_d"), F.lit(False)).alias("same_control"))


def contract(stored: DataFrame, current: DataFrame, keys: list[str], *, exempt: list[str], rtol: float = 1e-9) -> DataFrame:
    """JN7: stored against current values (hash and number) of each key; exempt keys may differ."""
    j = stored.join(current.select(*keys, F.col("hash").alias("_h"), F.col("number").alias("_n")), keys, "left")
    same = F.col("hash").eqNullSafe(F.col("_h")) & F.coalesce(F.abs(F.col("number") - F.col("_n")) <= rtol * F.greatest(F.abs("number"), F.abs("_n")), F.col("number").eqNullSafe(F.col("_n")))
    return j.select(*keys, F.coalesce(same, F.lit(False)).alias("same"), (F.coalesce(same, F.lit(False)) | F.col(keys[-1]).isin(exempt)).alias("passed"))


def nearest(df: DataFrame, bank: DataFrame, *, key: str, vector: str, bank_key: str, bank_vector: str, block: int = 20_000) -> DataFrame:
    """JN8: for each row the bank entry of least mean squared distance, the least key on ties: key, bank_key, distance.

    The bank goes to the tasks in ranges of keys with about `block` vectors each. Of several blocks only one is broadcast
    at a time: each block's pass is written as a table that carries the best so far, and its broadcast
    destroyed. Distances come from a matrix product; entries within rounding of the least are measured again.
    An empty bank gives nulls.
    """
    spark = df.sparkSession
    names = dict(df.dtypes)
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("d"))
    numbered = bank.select(F.col(bank_key).cast("long").alias("k"), F.col(bank_vector).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(bank.count() / block))
    if blocks > 1:  # ranges of keys, of about equal counts
        cuts = numbered.select(F.percentile_approx("k", F.array(*[F.lit(i / blocks) for i in range(blocks)]), F.lit(100 * blocks)).alias("k")).first()["k"]
        edges = sorted({*cuts, numbered.agg(F.min("k")).first()[0]})
    else:
        edges = [None]

    for i, low in enumerate(edges):
        part = numbered
        if low is not None:
            part = part.filter(F.col("k") >= low)
            part = part.filter(F.col("k") < edges[i + 1]) if i + 1 < len(edges) else part
        found = part.orderBy("k").collect()
        if not found:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["k"] for r in found]), np.array([r["v"] for r in found])))

        def find(batches, shared=shared):
            keys, m = shared.value
            size = np.square(m).sum(axis=1)
            for batch in batches:
                flat = batch.column(1)
                x = np.asarray(flat.flatten()).reshape(len(flat), -1)
                best, far = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for a in range(0, len(x), 256):
                    y = x[a : a + 256]
                    own = np.square(y).sum(axis=1)
                    d = size[None] + own[:, None] - 2 * (y @ m.T)
                    near = d <= d.min(axis=1, keepdims=True) + 1e-9 * (1 + own[:, None] + size.max())
                    for j, at in enumerate(map(np.flatnonzero, near)):
                        exact = np.square(m[at] - y[j]).mean(axis=1)
                        c = int(exact.argmin())
                        if best[a + j] is None or (exact[c], keys[at[c]]) < (far[a + j], best[a + j]):
                            best[a + j], far[a + j] = int(keys[at[c]]), float(exact[c])
                yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(best, pa.int64()), pa.array(far, pa.float64())], names=["k", "v", "b", "d"])

        rows = rows.mapInArrow(find, f"k {names[key]}, v array<double>, b bigint, d double")
        if len(edges) > 1:
            rows = stored(rows)
            shared.destroy()
    return rows.select(F.col("k").alias(key), F.col("b").alias(bank_key), F.col("d").alias("distance"))


LEVELS = 60


def cells(lo: Column, hi: Column, size: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def level(size: Column, cell: float) -> Column:
    """The grid level whose cells (cell * 2 ** level) are as large as the object: 0 for all up to a cell."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(cell)) / cell)), F.lit(0)), F.lit(LEVELS)).cast("int")


def levels_of(*tables: DataFrame) -> list[int]:
    """The levels (_own) that occur: LEVELS + 1 numbers at most."""
    some = tables[0].select("_own")
    for t in tables[1:]:
        some = some.union(t.select("_own"))
    return sorted(r["_own"] for r in some.distinct().collect() if r["_own"] is not None)


def meeting(own: list[int], others: list[int]) -> list[int]:
    """The levels at which boxes of own levels can meet boxes of others: none that lies below all of the others."""
    return sorted({*others, *(x for x in own if others and x >= min(others))})


def entered(df: DataFrame, known: list[int], x0: str, x1: str, y0: str, y1: str, *, cell: float, own_only: bool) -> DataFrame:
    """df with _lv, _cx, _cy: the cells in which an object enters at its own level, or at each known level from its own on; four at most of each level."""
    at = F.array("_own") if own_only else F.filter(F.array(*[F.lit(x) for x in known]).cast("array<int>"), lambda x: x >= F.col("_own"))
    d = df.withColumn("_lv", F.explode(at)).withColumn("_size", F.lit(cell) * F.pow(F.lit(2.0), F.col("_lv")))
    return d.withColumn("_cx", cells(F.col(x0), F.col(x1), F.col("_size"))).withColumn("_cy", cells(F.col(y0), F.col(y1), F.col("_size")))


GATHERED = 1000  # rows in one list, about


def gathered(df: DataFrame, shape: list[str]) -> DataFrame:
    """shape columns and _rows, lists of the other columns of the rows that share them; an often repeated shape has several lists."""
    w = F.count("*").over(Window.partitionBy(*shape))
    d = df.withColumn("_chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(w / GATHERED)))
    rest = [c for c in df.columns if c not in shape]
    return d.groupBy(*shape, "_chunk").agg(F.collect_list(F.struct(*(rest or [F.lit(0).alias("_none")]))).alias("_rows")).drop("_chunk")


def box_overlap(a: DataFrame, b: DataFrame, *, cell: float, repeats: bool = False) -> DataFrame:
    """JN9: pairs of boxes (x0, x1, y0, y1) that overlap with positive area, by shared cells of a hierarchy of grids instead of all pairs.

    A box lies in four cells at most of the level of its size, however large it is, and in as many of each coarser level at which it can meet another.
    A pair meets at the level of the larger box, and is taken in the cell of its overlap's lower corner. Columns of
    b get b_ in front. Boxes with a null side overlap nothing. With repeats, equal boxes are joined once, and all pairs of their rows are made from lists.
    """
    sides = ["x0", "x1", "y0", "y1"]
    if repeats:
        j = box_overlap(stored(gathered(a, sides)), stored(gathered(b, sides)), cell=cell)
        j = j.withColumn("_a", F.explode("_rows")).withColumn("_b", F.explode("b__rows"))
        side = lambda c, p: F.col(p + c if c in sides else f"_{p[0] if p else 'a'}.{c}").alias(p + c)
        return j.select(*[side(c, "") for c in a.columns], *[side(c, "b_") for c in b.columns])
    size = level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), cell)
    left, right = (d.withColumn("_own", size).filter("_own is not null") for d in (a, b))
    own, others = levels_of(left), levels_of(right)
    names = [F.col(c).alias(f"b_{c}") for c in b.columns]
    left = entered(left, meeting(own, others), *sides, cell=cell, own_only=False)
    right = entered(right, meeting(others, own), *sides, cell=cell, own_only=False).select(*names, F.col("_own").alias("_b_own"), "_lv", "_cx", "_cy")
    j = left.join(right, ["_lv", "_cx", "_cy"])
    meet = (F.col("x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("x1")) & (F.col("y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("y1"))
    home = (F.floor(F.greatest("x0", "b_x0") / F.col("_size")) == F.col("_cx")) & (F.floor(F.greatest("y0", "b_y0") / F.col("_size")) == F.col("_cy"))
    return j.filter(meet & home & (F.col("_lv") == F.greatest("_own", "_b_own"))).drop("_lv", "_cx", "_cy", "_own", "_b_own", "_size")


def inside_ellipse(points: DataFrame, ellipses: DataFrame, *, cell: float, repeats: bool = False) -> DataFrame:
    """JN10: points (x, y) inside rotated ellipses (center_x, center_y, radius_x, radius_y, angle), with r2; an ellipse lies in four cells at most of the grid of its size, and a point looks into one cell of each grid that occurs.

    With repeats, equal points and equal ellipses are joined once, and all pairs of their rows are made from lists.
    """
    if repeats:
        shape = ["center_x", "center_y", "radius_x", "radius_y", "angle"]
        j = inside_ellipse(stored(gathered(points, ["x", "y"]).withColumnRenamed("_rows", "_points")), stored(gathered(ellipses, shape)), cell=cell)
        j = j.withColumn("_a", F.explode("_points")).withColumn("_b", F.explode("_rows"))
        own = [F.col(c if c in ("x", "y") else f"_a.{c}").alias(c) for c in points.columns]
        return j.select(*own, *[F.col(c if c in shape else f"_b.{c}").alias(c) for c in ellipses.columns], "r2")
    reach = F.greatest("radius_x", "radius_y")
    e = ellipses.withColumn("_own", level(2 * reach, cell)).filter("_own is not null")
    known = levels_of(e)
    e = e.withColumns({"_x0": F.col("center_x") - reach, "_x1": F.col("center_x") + reach, "_y0": F.col("center_y") - reach, "_y1": F.col("center_y") + reach})
    e = entered(e, known, "_x0", "_x1", "_y0", "_y1", cell=cell, own_only=True).drop("_x0", "_x1", "_y0", "_y1", "_own", "_size")
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_lv"))
    p = points.withColumn("_lv", F.explode(F.array(*[F.lit(x) for x in known]).cast("array<int>"))).withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    j = p.join(e, ["_lv", "_cx", "_cy"])
    dx, dy = F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y")
    u, v = dx * F.cos("angle") + dy * F.sin("angle"), dy * F.cos("angle") - dx * F.sin("angle")
    return j.withColumn("r2", F.pow(u / F.col("radius_x"), 2) + F.pow(v / F.col("radius_y"), 2)).filter("r2 <= 1").drop("_lv", "_cx", "_cy")
