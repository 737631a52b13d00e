"""Sparse operators, meshes and graphs as tables.

Sparse operators are tables (row, col, value); elements are (elem_id, n0, n1, n2), nodes (node_id, x, y, is_boundary).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.functions.arrays import quantile
from beatframe.functions.tables import stored
from beatframe.operators.rings import MAX_BYTES, apply_sparse, images  # noqa: F401


def zero_based(coo: DataFrame) -> DataFrame:
    """IO6: 1-based and with swapped axes, as stored, to (row, col, value) with repeats summed."""
    return coo.select((F.col("col") - 1).alias("row"), (F.col("row") - 1).alias("col"), "value").groupBy("row", "col").agg(F.sum("value").alias("value"))


def raster(coo: DataFrame, frames: DataFrame, key: list[str], vector: str, *, side: int, ring: str | None = None) -> DataFrame:
    """MG2: pixels of each frame (pixel p lies at row p mod side, column p div side); NaN where no element covers it. Made by the task that holds the frame, as one array (rings.images), then laid out."""
    d = images(coo, frames, key, vector, side=side, ring=ring).select(*key, F.posexplode("image").alias("p", "y"))
    return d.select(*key, (F.col("p") % side).alias("row"), F.floor(F.col("p") / side).alias("col"), "y")


def categorical_raster(coo: DataFrame, labels: DataFrame, *, background: int, pixels: int) -> DataFrame:
    """MG3: each pixel's class of most coverage, the lowest on ties; background where nothing covers it."""
    c = coo.join(labels.select(F.col("elem_id").alias("col"), "label"), "col").groupBy("row", "label").agg(F.sum("value").alias("w")).filter("w > 0")
    top = F.row_number().over(Window.partitionBy("row").orderBy(F.desc(F.round("w", 9)), "label"))
    best = c.withColumn("_n", top).filter("_n = 1").select(F.col("row").alias("p"), "label")
    return coo.sparkSession.range(pixels).select(F.col("id").alias("p")).join(best, "p", "left").select("p", F.coalesce("label", F.lit(background)).alias("label"))


def gram(coo: DataFrame) -> DataFrame:
    """MG4: the transpose times the matrix, entries (i, j, value)."""
    a, b = coo.select("row", F.col("col").alias("i"), F.col("value").alias("a")), coo.select("row", F.col("col").alias("j"), F.col("value").alias("b"))
    return a.join(b, "row").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def adjacency(elements: DataFrame, *, shared: int = 1) -> DataFrame:
    """MG5: pairs of elements with at least one node in common (shared 1) or exactly two (2), both ways.

    A pair is taken at the least node that it shares, so pairs are not grouped. Joins are merges, as exploded tables are larger than their files tell.
    """
    nodes = elements.select("elem_id", F.explode(F.array("n0", "n1", "n2")).alias("node")).groupBy("elem_id").agg(F.collect_set("node").alias("nodes"))
    a = nodes.select(F.col("elem_id").alias("src"), F.col("nodes").alias("a"), F.explode("nodes").alias("node"))
    b = nodes.select(F.col("elem_id").alias("dst"), F.col("nodes").alias("b"), F.explode("nodes").alias("node"))
    pairs = a.join(b.hint("merge"), "node").filter("src <> dst").withColumn("k", F.array_intersect("a", "b")).filter(F.col("node") == F.array_min("k"))
    return pairs.filter(F.size("k") >= 1 if shared == 1 else F.size("k") == shared).select("src", "dst")


def geometry(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """MG9: area, bounding box and centroid of each element."""
    e = elements
    for i in range(3):
        e = e.join(nodes.select(F.col("node_id").alias(f"n{i}"), F.col("x").alias(f"x_{i}"), F.col("y").alias(f"y_{i}")).hint("merge"), f"n{i}")
    c = F.col
    area = F.abs((c("x_1") - c("x_0")) * (c("y_2") - c("y_0")) - (c("x_2") - c("x_0")) * (c("y_1") - c("y_0"))) / 2
    xs, ys = [f"x_{i}" for i in range(3)], [f"y_{i}" for i in range(3)]
    return e.select(
        "elem_id", area.alias("area"), F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1"),
        ((c("x_0") + c("x_1") + c("x_2")) / 3).alias("cx"), ((c("y_0") + c("y_1") + c("y_2")) / 3).alias("cy"), F.array(*[F.array(x, y) for x, y in zip(xs, ys, strict=True)]).alias("corners"),
    )


def pixel_grid(nodes: DataFrame, side: int) -> DataFrame:
    """MG8: pixel boxes over the nodes' extent, p = col * side + row, rows downwards."""
    m = nodes.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    p = m.select("*", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("p"))
    w, h = (F.col("b") - F.col("a")) / side, (F.col("d") - F.col("c")) / side
    col, row = F.floor(F.col("p") / side), F.col("p") % side
    return p.select("p", (F.col("a") + col * w).alias("x0"), (F.col("a") + (col + 1) * w).alias("x1"), (F.col("d") - (row + 1) * h).alias("y0"), (F.col("d") - row * h).alias("y1"))


def clipped_area(corners: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Area of a convex polygon (an array of points [x, y]) inside a box, from its edges alone.

    Above each x the part inside the box is the top edge's height less the bottom one's, both clamped to
    the box; so each edge adds the integral of its clamped height over the x it spans inside the box.
    """
    n = F.size(corners)

    def piece(p, i):
        q = F.get(corners, (i + 1) % n)
        dx = q[0] - p[0]
        u, w = F.least(F.greatest(p[0], x0), x1), F.least(F.greatest(q[0], x0), x1)
        height = lambda x: p[1] + (q[1] - p[1]) * F.coalesce(F.try_divide(x - p[0], dx), F.lit(0.0))
        lo, hi = F.least(height(u), height(w)), F.greatest(height(u), height(w))
        below, above = F.greatest(F.least(hi, y0) - lo, F.lit(0.0)), F.greatest(hi - F.greatest(lo, y1), F.lit(0.0))
        a, b = F.greatest(lo, y0), F.least(hi, y1)
        within = F.greatest(b - a, F.lit(0.0))
        mean = F.try_divide(below * y0 + within * (a + b) / 2 + above * y1, hi - lo)
        return (w - u) * (F.coalesce(mean, F.least(F.greatest(lo, y0), y1)) - y0)

    return F.abs(F.aggregate(F.transform(corners, piece), F.lit(0.0), lambda s, x: s + x))


def image_map(nodes: DataFrame, elements: DataFrame, side: int, *, cell: float) -> DataFrame:
    """MG6: (row = pixel, col = element, value): overlap area as a share of the element, rows normalised to 1."""
    from beatframe.operators.joins import box_overlap

    j = box_overlap(pixel_grid(nodes, side), stored(geometry(nodes, elements)), cell=cell)  # read twice: for its levels, and for the join
    j = j.withColumn("w", F.try_divide(clipped_area(F.col("b_corners"), *[F.col(c) for c in ("x0", "x1", "y0", "y1")]), "b_area")).filter("w > 1e-9")  # less is rounding
    return j.select(F.col("p").cast("long").alias("row"), F.col("b_elem_id").alias("col"), (F.col("w") / F.sum("w").over(Window.partitionBy("p"))).alias("value"))


def outside(coo: DataFrame, pixels: int) -> DataFrame:
    """MG7: the pixels that no element covers."""
    covered = coo.groupBy("row").agg(F.sum("value").alias("s")).filter("s <> 0").select(F.col("row").alias("p"))
    return coo.sparkSession.range(pixels).select(F.col("id").alias("p")).join(covered, "p", "left_anti")


def domain_circle(nodes: DataFrame, *, median: bool = False) -> DataFrame:
    """MG10: centre of the boundary nodes and their mean (or median) distance from it; one row."""
    b = nodes.filter("is_boundary")
    c = b.agg(F.avg("x").alias("center_x"), F.avg("y").alias("center_y"))
    d = b.crossJoin(F.broadcast(c)).withColumn("r", F.sqrt(F.pow(F.col("x") - F.col("center_x"), 2) + F.pow(F.col("y") - F.col("center_y"), 2)))
    return d.groupBy("center_x", "center_y").agg((F.percentile("r", 0.5) if median else F.avg("r")).alias("radius"))


def element_positions(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """MG11: centroids in units of the domain circle: x, y, r."""
    d = geometry(nodes, elements).crossJoin(F.broadcast(domain_circle(nodes)))
    x, y = (F.col("cx") - F.col("center_x")) / F.col("radius"), (F.col("cy") - F.col("center_y")) / F.col("radius")
    return d.select("elem_id", x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("r"))


def to_fine(coo: DataFrame, frames: DataFrame, key: list[str], vector: str, *, atol: float = 1e-12, ring: str | None = None) -> DataFrame:
    """MG12: MG1 with a map whose rows sum to 1; rows (of a ring) that don't are left out."""
    row = ["row", *([ring] if ring else [])]
    good = coo.groupBy(*row).agg(F.sum("value").alias("s")).filter(F.abs(F.col("s") - 1) <= atol).select(*row)
    return apply_sparse(coo.join(good, row, "left_semi"), frames, key, vector, ring=ring)


def chain_jacobian(fine: DataFrame, coarse_map: DataFrame) -> DataFrame:
    """MG13: (channel, col, value) of the fine Jacobian (channel, row, value) times the map."""
    j = fine.select("channel", "row", F.col("value").alias("a")).join(coarse_map.select("row", "col", F.col("value").alias("b")), "row")
    return j.groupBy("channel", "col").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def turned(points: DataFrame, angle: float) -> DataFrame:
    """Points (x, y) in axes turned by the angle."""
    c, s = float(np.cos(angle)), float(np.sin(angle))
    return points.withColumns({"x": c * F.col("x") + s * F.col("y"), "y": c * F.col("y") - s * F.col("x")})


SHAPE = ["center_x", "center_y", "radius_x", "radius_y", "angle"]


def layered_field(positions: DataFrame, bands: list[tuple[float, int, float]], ellipses: DataFrame, *, rotation: float = 0.0, cell: float = 0.25) -> DataFrame:
    """MG14: label, baseline, delta and dynamic (their sum) of each element (elem_id, x, y) of an anatomy turned by rotation.

    bands (least radius, label, value): the outermost that the element reaches. An ellipse (elem of
    ellipses: order, ellipse_label, value, delta and its shape) that holds it replaces label and value, the
    last in order where several do; deltas of all that do add up. Below the first band they are null. Equal ellipses are compared once.
    """
    from beatframe.operators.joins import inside_ellipse

    points = turned(positions, rotation)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    label = value = F.lit(None)
    for least, lab, val in sorted(bands):
        label, value = F.when(r >= least, lab).otherwise(label), F.when(r >= least, val).otherwise(value)
    base = points.select("elem_id", label.cast("int").alias("label"), value.cast("double").alias("baseline"))
    few = ellipses.groupBy(*SHAPE).agg(F.max(F.struct("order", "ellipse_label", "value")).alias("top"), F.sum("delta").alias("delta"))
    hit = inside_ellipse(points.select("elem_id", "x", "y"), stored(few), cell=cell).groupBy("elem_id").agg(F.max("top").alias("_top"), F.sum("delta").alias("_delta"))
    d = base.join(hit, "elem_id", "left").select("elem_id", F.coalesce("_top.ellipse_label", "label").alias("label"), F.coalesce("_top.value", "baseline").alias("baseline"), F.coalesce("_delta", F.lit(0.0)).alias("delta"))
    return d.withColumn("dynamic", F.col("baseline") + F.col("delta"))


def vessel_targets(positions: DataFrame, vessels: DataFrame, frame: str, *, slots: int = 2) -> DataFrame:
    """MG15: of each frame and element: hard, whether any of the frame's vessels (slot from 0, center_x, center_y, radius_x, radius_y, angle) holds it; cores, whether each does; soft, each one's Gaussian exp(-r2 / 2 / 1.25^2), zero beyond r2 > 9. Elements out of all vessels' reach have no row."""
    from beatframe.operators.joins import inside_ellipse

    reach = {c: F.greatest(c, F.lit(1e-5)) * 3 for c in ("radius_x", "radius_y")}
    few = stored(vessels.select(frame, "slot", *SHAPE).distinct().withColumns(reach))  # equal vessels hold the same elements
    j = inside_ellipse(positions.select("elem_id", "x", "y"), few, cell=0.5).withColumn("r2", F.col("r2") * 9)
    own = lambda i, x: F.max(F.when(F.col("slot") == i, x))
    cores = F.array(*[F.coalesce(own(i, F.col("r2") <= 1), F.lit(False)) for i in range(slots)])
    soft = F.array(*[F.coalesce(own(i, F.exp(-F.col("r2") / 2 / 1.25**2)), F.lit(0.0)) for i in range(slots)])
    return j.groupBy(frame, "elem_id").agg(F.max(F.col("r2") <= 1).alias("hard"), cores.alias("cores"), soft.alias("soft"))


def vessel_centres(vessels: DataFrame, frame: str) -> DataFrame:
    """MG15: the centres of each frame's vessels, by slot."""
    c = F.array_sort(F.collect_list(F.struct("slot", F.col("center_x").alias("x"), F.col("center_y").alias("y"))))
    return vessels.groupBy(frame).agg(F.transform(c, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("centres"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with i, their place from 0 in the order of a column: a sorted table is written in parts, and only the parts' sizes are collected."""
    d = stored(rows.orderBy(order).withColumn("_n", F.monotonically_increasing_id()))
    part, at = F.shiftright("_n", 33).alias("_part"), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in d.groupBy(part).agg(F.count("*").alias("k")).orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r["k"]
    begin = rows.sparkSession.createDataFrame(starts, "_part long, _begin long")
    return d.select("*", part).join(F.broadcast(begin), "_part").withColumn("i", F.col("_begin") + at).drop("_n", "_part", "_begin")


BLOCK, SLOTS = 8192, 256  # elements, and slots, about, of a task's group


def slot_masks(positions: DataFrame, slots: DataFrame, frame: str, *, temperature: float = 0.05, diffusion: bool = False, parts: bool = True) -> DataFrame:
    """MG16: frame, first, conductivity and, with parts, cores and (with diffusion) halos: smooth ellipses of a frame's slots (slot, center_x, center_y, radius_x, radius_y, angle, amplitude) over a mesh's elements.

    A core is sigmoid((1 - r2) / temperature). A halo is a Gaussian of the distance from the wall in units of
    the slot's diffusion_length, outside the core and gated by the element's gate (0 to 1); diffusion_fraction
    of the amplitude goes there. Every frame has a value on every element of the mesh (elem_id, x, y, and gate): vectors are
    in the order of elem_id, in blocks, of which `first` is the first element's place from 0. cores and halos have
    one vector for each slot. Without parts, equal ellipses of a frame are computed once, with the sum of their amplitudes.
    """
    names = ["center_x", "center_y", "radius_x", "radius_y", "angle", "amplitude", *(["diffusion_fraction", "diffusion_length"] if diffusion else [])]
    s = slots.select(frame, "slot", *[F.col(c).cast("double").alias(c) for c in names])
    if not parts:
        s = s.groupBy(frame, *[c for c in names if c != "amplitude"]).agg(F.sum("amplitude").alias("amplitude")).select(frame, F.lit(0).alias("slot"), *names)
    s = stored(s)
    mesh = numbered(positions.select("elem_id", "x", "y", (F.col("gate") if diffusion else F.lit(1.0)).alias("gate")), "elem_id")
    blocks, shares = -(-mesh.count() // BLOCK), max(1, -(-s.count() // SLOTS))
    key = lambda block, share: (block * shares + share).cast("long").alias("_k")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    left = mesh.select("i", "x", "y", "gate", F.floor(F.col("i") / BLOCK).alias("_b"), each(shares).alias("_s")).select(key(F.col("_b"), F.col("_s")), "i", "x", "y", "gate")
    right = s.select("*", each(blocks).alias("_b")).select(key(F.col("_b"), F.pmod(F.xxhash64(frame), F.lit(shares))), frame, "slot", *names)
    kind = dict(slots.dtypes)[frame]
    out = ["conductivity", *(["cores", *(["halos"] if diffusion else [])] if parts else [])]
    one, many = pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))

    def run(e: pa.Table, t: pa.Table) -> pa.Table:
        e, t = e.sort_by("i"), t.sort_by([(frame, "ascending"), ("slot", "ascending")])
        x, y, gate = (e[c].to_numpy() for c in ("x", "y", "gate"))
        gate = np.clip(gate, 0, 1)
        p = np.stack([t[c].to_numpy() for c in names], axis=1)
        code = np.asarray(t[frame].combine_chunks().dictionary_encode("encode").indices)
        starts = np.flatnonzero(np.diff(code, prepend=-1)) if len(x) else np.zeros(0, np.int64)
        lists: list[list] = [[] for _ in out]
        for begin, end in zip(starts, [*starts[1:], len(p)], strict=False):
            total, cores, halos = np.zeros(len(x)), [], []
            for at in range(begin, end):
                cx, cy, rx, ry, angle, amplitude = p[at, :6]
                dx, dy, c, sn, a, b = x - cx, y - cy, np.cos(angle), np.sin(angle), max(rx, 1e-4), max(ry, 1e-4)
                r2 = ((c * dx + sn * dy) / a) ** 2 + ((c * dy - sn * dx) / b) ** 2 + (1e-12 if diffusion else 0)
                value = core = 1 / (1 + np.exp(np.minimum((r2 - 1) / temperature, 700)))
                if diffusion:
                    wall = np.maximum(np.sqrt(r2) - 1, 0) * np.sqrt(a * b)
                    halo = (1 - core) * np.exp(-0.5 * (wall / max(p[at, 7], 1e-4)) ** 2) * gate
                    value = core + p[at, 6] * halo
                    halos += [halo] if parts else []
                total += amplitude * value
                cores += [core] if parts else []
            for held, v in zip(lists, (total, cores, halos), strict=False):
                held.append(v)
        columns = [t[frame].take(pa.array(starts)), pa.array(np.full(len(starts), e["i"][0].as_py() if len(x) else 0)), pa.array(lists[0], one), *[pa.array(v, many) for v in lists[1:]]]
        return pa.table(columns, names=[frame, "first", *out])

    schema = ", ".join([f"{frame} {kind}, first long, conductivity array<double>", *[f"{c} array<array<double>>" for c in out[1:]]])
    return left.groupBy("_k").cogroup(right.groupBy("_k")).applyInArrow(run, schema)


def vessel_parameters(records: DataFrame, *, rotation: str, scale: float, diffusion: bool = False) -> DataFrame:
    """MG17: the vessels of each record (vessels: center_x, center_y, axis_a, axis_b, angle; vessel_delta: amplitudes) in the mesh's axes.

    Centres are turned by the record's rotation, angles in [-pi, pi), amplitudes scaled. With diffusion also
    the simulator's fraction, and its length in mesh units: a mesh unit is the vessel's mean semi-axis over
    the lumen's mean radius in mm. two says whether the record has exactly two vessels, as models expect.
    """
    keep = [c for c in records.columns if c not in ("vessels", "vessel_delta", "simulator", rotation)]
    side = [F.col("simulator").alias("_m")] if diffusion else []
    d = records.select(*keep, F.col(rotation).alias("_r"), F.col("vessel_delta").alias("_d"), *side, (F.size("vessels") == 2).alias("two"), F.posexplode("vessels").alias("slot", "v"))
    x, y, turn = F.col("v.center_x"), F.col("v.center_y"), 2 * np.pi
    columns = {
        "x": x * F.cos("_r") - y * F.sin("_r"), "y": x * F.sin("_r") + y * F.cos("_r"), "axis_a": F.col("v.axis_a"), "axis_b": F.col("v.axis_b"),
        "angle": F.pmod(F.col("v.angle") + F.col("_r") + np.pi, F.lit(turn)) - np.pi, "amplitude": F.get("_d", F.col("slot")) / scale,
    }
    if diffusion:
        artery = F.get("_m.arteries", F.col("slot"))
        radius = F.sqrt(artery["radius_x_mm"] * artery["radius_y_mm"]) * F.coalesce(artery["lumen_fraction"], F.lit(1.0))
        columns["diffusion_fraction"] = F.coalesce("_m.muscle_diffusion_fraction", F.lit(0.0))
        columns["diffusion_length"] = F.coalesce("_m.muscle_diffusion_length_mm", F.lit(1.0)) * F.sqrt(F.col("v.axis_a") * F.col("v.axis_b")) / F.greatest(radius, F.lit(1e-8))
    return d.select(*keep, "slot", "two", *[v.alias(k) for k, v in columns.items()])


def ellipse_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """MG18: mean, semi-axes sqrt(2 * eigenvalue) of the population covariance, and the angle of the longer one."""
    g = points.groupBy(*by).agg(F.avg("x").alias("center_x"), F.avg("y").alias("center_y"), F.var_pop("x").alias("_a"), F.var_pop("y").alias("_c"), F.covar_pop("x", "y").alias("_b"))
    half, root = (F.col("_a") + F.col("_c")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_c")) / 2, 2) + F.col("_b") * F.col("_b"))
    return g.select(*by, "center_x", "center_y", F.sqrt(2 * (half + root)).alias("major"), F.sqrt(2 * F.greatest(half - root, F.lit(0.0))).alias("minor"), (F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c")) / 2).alias("angle"))


def labelled_cells(frame: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct cells by frame, row and column, and for each in that order the first cell of its 8-neighbour component: least labels of neighbours, with shortcuts, over all frames at once."""
    number = np.unique(frame, return_inverse=True)[1].astype(np.int64)
    high, wide = int(row.max()) + 3, int(col.max()) + 3
    key = (number * high + row + 1) * wide + col + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    left, right = [], []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        ok = np.flatnonzero(key[at] == key + step)
        left.append(ok)
        right.append(at[ok])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(key))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return order, label
        label = new


def grid_labels(cells: DataFrame, by: str, *, frames_per_task: int = 500) -> DataFrame:
    """MG19: each marked cell (row and col from 0) of each frame's grid with its component's rank (by size, the one of the first cell on ties), size, row_mean and col_mean.

    Frames share tasks; a frame's grid is 40 x 40 at most, so a task's part is bounded.
    """
    d = cells.select(by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    shares = max(1, d.select(F.approx_count_distinct(by)).first()[0] // frames_per_task)

    def label(t: pa.Table) -> pa.Table:
        t = t.drop_columns("_share")
        code = t[by].combine_chunks().dictionary_encode()
        frame = np.asarray(code.indices.fill_null(-1)) + 1
        row, col = np.asarray(t["row"]).astype(np.int64), np.asarray(t["col"]).astype(np.int64)
        order, first = labelled_cells(frame, row, col)
        frame, row, col = frame[order], row[order], col[order]
        size = np.bincount(first, minlength=len(first))
        mean = [np.bincount(first, v, minlength=len(first)) / np.maximum(size, 1) for v in (row, col)]
        heads = np.flatnonzero(size)
        heads = heads[np.lexsort((heads, -size[heads], frame[heads]))]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(frame[heads])) + 1])
        rank = np.zeros(len(first), np.int64)
        rank[heads] = np.arange(len(heads)) - np.repeat(begin, np.diff(np.append(begin, len(heads)))) + 1
        out = {by: t[by].take(pa.array(order)), "row": pa.array(row.astype(np.int32)), "col": pa.array(col.astype(np.int32)), "rank": pa.array(rank[first].astype(np.int32)), "size": pa.array(size[first])}
        return pa.table({**out, "row_mean": pa.array(mean[0][first]), "col_mean": pa.array(mean[1][first])})

    kind = dict(cells.dtypes)[by]
    shared = d.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(shares)))
    return shared.groupBy("_share").applyInArrow(label, f"{by} {kind}, row int, col int, rank int, size long, row_mean double, col_mean double")


def grid_components(cells: DataFrame, by: str, *, keep: int = 2) -> DataFrame:
    """MG19: size and centroid of the largest components of each frame."""
    g = grid_labels(cells, by).filter(F.col("rank") <= keep)
    return g.groupBy(by, "rank").agg(F.first("size").alias("size"), F.first("row_mean").alias("row_mean"), F.first("col_mean").alias("col_mean"))


def propagate(edges: DataFrame, features: DataFrame, frame: str) -> DataFrame:
    """MG20: D^-1/2 (A + I) D^-1/2 x for features (frame, node, x). Edges are dealt out by dst once; joins are merges, so nothing of the graph's size is broadcast."""
    loops = features.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct()
    e = edges.select("src", "dst").unionByName(loops).repartition("dst").distinct()
    degree = e.groupBy("dst").agg(F.count("*").alias("d"))
    x = features.withColumnRenamed("node", "src").join(degree.select(F.col("dst").alias("src"), F.col("d").alias("ds")).hint("merge"), "src")
    j = e.join(degree.hint("merge"), "dst").join(x.hint("merge"), "src")
    return j.groupBy(frame, "dst").agg(F.sum(F.col("x") / F.sqrt(F.col("d") * F.col("ds"))).alias("y")).withColumnRenamed("dst", "node")


def mesh_points(positions: DataFrame) -> DataFrame:
    """One row: _points, the elements of one mesh in the order of elem_id. It goes to every task, so a mesh above rings.MAX_BYTES is refused (a ring's has about 1,500 elements)."""
    most = MAX_BYTES // 24
    if positions.limit(most + 1).count() > most:
        raise ValueError(f"a mesh of more than {most} elements is too large to send to every task")
    return positions.agg(F.array_sort(F.collect_list(F.struct("elem_id", "x", "y"))).alias("_points"))


def coordinate(name: str) -> Column:
    return F.transform("_points", lambda p: p[name]).alias(name)


def scaled_vector(vector: str, scale) -> Column:
    return F.transform(vector, lambda x: x / scale)


def node_features(df: DataFrame, positions: DataFrame | None = None, *, state: str, direction: str, target: str, scale: float, alpha: float = 1.0, reference: str | None = None, voltage: str | None = None, voltage_scale: float = 1.0) -> DataFrame:
    """MG21: adds features (an array of structs: state and direction in units of scale, and with positions x and y), y (the scaled target), weight, background, and with them reference and voltage, scaled.

    The supervised signal is the target less the reference. Its size over the median of its nonzero sizes (1
    where there is none), cut to 0 to 2, weighs an element 1 + alpha times that; up to 1e-8 it is background.
    """
    d = df.withColumn("y", scaled_vector(target, scale))
    signal = F.transform("y", F.abs)
    if reference is not None:
        d = d.withColumn("reference_scaled", scaled_vector(reference, scale))
        signal = F.zip_with("y", "reference_scaled", lambda y, r: F.abs(y - r))
    if voltage is not None:
        d = d.withColumn("voltage_scaled", scaled_vector(voltage, max(voltage_scale, 1e-12)))
    d = d.withColumn("_size", signal)
    median = F.coalesce(quantile(F.filter("_size", lambda x: x > 0), 0.5), F.lit(1.0))
    d = d.withColumn("_m", F.greatest(median, F.lit(1e-8)))
    d = d.withColumn("weight", F.transform("_size", lambda x: 1 + alpha * F.least(x / F.col("_m"), F.lit(2.0)))).withColumn("background", F.transform("_size", lambda x: x <= 1e-8))
    parts = [scaled_vector(state, scale).alias("state"), scaled_vector(direction, scale).alias("direction")]
    if positions is not None:
        d = d.crossJoin(F.broadcast(mesh_points(positions)))  # one row
        parts += [coordinate(c) for c in ("x", "y")]
        d = d.withColumn("features", F.arrays_zip(*parts)).drop("_points")
    else:
        d = d.withColumn("features", F.arrays_zip(*parts))
    return d.drop("_m", "_size")


def clipped_ratio(vector: str, size: Column, limit: float) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.least(x / size, F.lit(limit)), F.lit(-limit)))


def beat_features(df: DataFrame, positions: DataFrame, *, state: str, direction: str, voltage: str, scale: float, template: str | None = None, context: str | None = None, tissue: str | None = None, rms_reference: float = 1.0, voltage_scale: float | None = None, muscle: int = 3) -> DataFrame:
    """MG22: adds features, geometry, voltage_input, template_input, log_rms and muscle_gate.

    By beat: voltage and template (the voltage itself where there is none) over their RMS, cut to +-8; log of
    the voltage's RMS over a reference, cut to +-5; context (the direction where there is none) as
    sizes over their 95th percentile, cut to 0 to 5, which joins state, direction and positions as a feature.
    With voltage_scale instead: voltage over that scale, log RMS zero, and no context; geometry has the scaled
    direction's size. muscle_gate is 1 on muscle, and everywhere without tissue.
    """
    from beatframe.functions.arrays import rms

    template, context = template or voltage, context or direction
    d = df.crossJoin(F.broadcast(mesh_points(positions)))  # one row
    xy = [coordinate(c) for c in ("x", "y")]
    parts = [scaled_vector(state, scale).alias("state"), scaled_vector(direction, scale).alias("direction")]
    if voltage_scale is None:
        d = d.withColumn("_u", F.greatest(rms(voltage), F.lit(1e-12))).withColumn("_t", F.greatest(rms(template), F.lit(1e-12)))
        d = d.withColumn("voltage_input", clipped_ratio(voltage, F.col("_u"), 8.0)).withColumn("template_input", clipped_ratio(template, F.col("_t"), 8.0))
        d = d.withColumn("log_rms", F.greatest(F.least(F.log(F.col("_u") / max(rms_reference, 1e-12)), F.lit(5.0)), F.lit(-5.0)))
        d = d.withColumn("_p", F.greatest(quantile(F.transform(context, F.abs), 0.95), F.lit(1e-12)))
        near = F.transform(context, lambda x: F.least(F.abs(x) / F.col("_p"), F.lit(5.0))).alias("context")
        d = d.withColumn("features", F.arrays_zip(*parts, near, *xy)).withColumn("geometry", F.arrays_zip(near, *xy)).drop("_u", "_t", "_p")
    else:
        d = d.withColumn("voltage_input", scaled_vector(voltage, voltage_scale)).withColumn("template_input", F.col("voltage_input")).withColumn("log_rms", F.lit(0.0))
        d = d.withColumn("features", F.arrays_zip(*parts, *xy)).withColumn("geometry", F.arrays_zip(F.transform(direction, lambda x: F.abs(x) / scale).alias("direction"), *xy))
    gate = F.transform(tissue, lambda x: (x == muscle).cast("double")) if tissue else F.transform("_points", lambda p: F.lit(1.0))
    return d.withColumn("muscle_gate", gate).drop("_points")
