"""Steps whose tables grow with the mesh: what they send, hold and repeat."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.operators import mesh


def planned(d):
    return d._jdf.queryExecution().executedPlan().toString()


ELEMENTS = [(1, 1, 2, 3), (2, 2, 3, 4), (3, 3, 4, 5), (4, 9, 9, 5), (5, 20, 21, 22), (2, 2, 3, 4), (None, 1, 2, 3), (6, 1, 2, 3)]


@pytest.mark.parametrize("shared", [1, 2])
def test_adjacency_is_neither_broadcast_nor_grouped_by_pairs(spark, shared):
    d = mesh.adjacency(spark.createDataFrame(ELEMENTS, "elem_id long, n0 long, n1 long, n2 long"), shared=shared)
    of = {e: set(n) for e, *n in ELEMENTS if e is not None}
    want = [p for a, b in combinations(of, 2) for p in ((a, b), (b, a)) if (len(of[a] & of[b]) >= 1 if shared == 1 else len(of[a] & of[b]) == 2)]
    assert sorted((r.src, r.dst) for r in d.collect()) == sorted(want)
    assert "Broadcast" not in planned(d) and "keys=[src" not in planned(d)


def test_propagation_broadcasts_nothing_of_the_graph(spark):
    import math

    edges, x = [(1, 2), (2, 1), (2, 3), (3, 2), (3, 2)], {(0, 1): 2.0, (0, 2): 3.0, (0, 3): 5.0, (1, 1): 1.0, (1, 2): 0.0, (1, 3): 4.0}
    d = mesh.propagate(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(f, n, v) for (f, n), v in x.items()], "frame long, node long, x double"), "frame")
    linked = set(edges) | {(n, n) for n in (1, 2, 3)}
    degree = {n: sum(t == n for _, t in linked) for n in (1, 2, 3)}
    got = {(r.frame, r.node): r.y for r in d.collect()}
    assert got == pytest.approx({(f, n): sum(x[f, s] / math.sqrt(degree[s] * degree[n]) for s, t in linked if t == n) for f, n in x})
    small = spark.range(50).select((F.col("id") % 7).alias("src"), (F.col("id") % 5).alias("dst"))
    features = spark.range(7).select(F.col("id").alias("node"), F.explode(F.array(F.lit(0), F.lit(1))).alias("frame"), F.lit(1.0).alias("x"))
    assert "Broadcast" not in planned(mesh.propagate(small, features, "frame"))


def test_masks_of_a_mesh_of_any_size(spark):
    n = 90_000  # more than one task is sent
    mesh_of = spark.range(n).select((F.col("id") * 3).alias("elem_id"), (F.col("id") % 300 / 150 - 1).alias("x"), (F.floor(F.col("id") / 300) / 150 - 1).alias("y"), (F.col("id") % 2).cast("double").alias("gate"))
    rows = [(7, 0, 0.1, 0.2, 0.5, 0.3, 0.4, 2.0, 0.3, 0.1), (7, 1, -0.4, 0.0, 0.2, 0.2, 0.0, 1.0, 0.3, 0.2), (7, 2, 0.1, 0.2, 0.5, 0.3, 0.4, 0.5, 0.3, 0.1), (8, 0, 0.0, 0.0, 0.2, 0.1, 1.0, 1.0, 0.0, 0.1)]
    names = "frame long, slot long, center_x double, center_y double, radius_x double, radius_y double, angle double, amplitude double, diffusion_fraction double, diffusion_length double"
    slots = spark.createDataFrame(rows, names)
    i = np.arange(n)
    x, y, gate = i % 300 / 150 - 1, i // 300 / 150 - 1, (i % 2).astype(float)

    def expected(diffusion):
        out = {7: [], 8: []}
        for f, _, cx, cy, rx, ry, angle, amplitude, fraction, length in rows:
            u, v = (x - cx) * np.cos(angle) + (y - cy) * np.sin(angle), (y - cy) * np.cos(angle) - (x - cx) * np.sin(angle)
            r2 = (u / rx) ** 2 + (v / ry) ** 2 + (1e-12 if diffusion else 0)
            core = 1 / (1 + np.exp(np.minimum((r2 - 1) / 0.05, 700)))
            halo = (1 - core) * np.exp(-0.5 * (np.maximum(np.sqrt(r2) - 1, 0) * np.sqrt(rx * ry) / length) ** 2) * gate if diffusion else 0 * core
            out[f].append((core, halo, amplitude * (core + fraction * halo)))
        return out

    for diffusion in (False, True):
        want = expected(diffusion)
        for parts in (False, True):
            found = mesh.slot_masks(mesh_of, slots, "frame", diffusion=diffusion, parts=parts).orderBy("frame", "first").collect()
            for f in (7, 8):
                mine = [r for r in found if r.frame == f]
                assert [r.first for r in mine] == list(range(0, n, mesh.BLOCK))
                np.testing.assert_allclose(np.concatenate([r.conductivity for r in mine]), sum(w[2] for w in want[f]), atol=1e-12)
                if parts:
                    np.testing.assert_allclose(np.concatenate([r.cores for r in mine], axis=1), [w[0] for w in want[f]], atol=1e-12)
                if parts and diffusion:
                    np.testing.assert_allclose(np.concatenate([r.halos for r in mine], axis=1), [w[1] for w in want[f]], atol=1e-12)


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    from beatframe.operators import joins

    monkeypatch.setattr(joins, "GATHERED", 7)
    a = [(i, float(i % 3), float(i % 3 + 1), 0.0, 1.0 + 100 * (i % 2)) for i in range(60)] + [(99, None, 1.0, 0.0, 1.0)] * 2 + [(5, 2.0, 3.0, 0.0, 101.0)]
    b = [(i, 0.5, 2.5, -1.0, 2.0) for i in range(30)] + [(50, 2.0, 3.0, 0.5, 0.6)]
    kind = "k long, x0 double, x1 double, y0 double, y1 double"
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    meets = lambda p, q: None not in p + q and p[1] < q[2] and q[1] < p[2] and p[3] < q[4] and q[3] < p[4]
    got = [tuple(r) for r in joins.box_overlap(left, right, cell=1.0, repeats=True).select("k", "x0", "b_k", "b_y1").collect()]
    assert sorted(got) == sorted((p[0], p[1], q[0], q[4]) for p in a for q in b if meets(p, q))
    lists = joins.gathered(right, ["x0", "x1", "y0", "y1"]).collect()
    assert len({tuple(r)[:4] for r in lists}) == 2 and max(len(r["_rows"]) for r in lists) < 30


def test_equal_points_and_ellipses_are_compared_once(spark):
    from beatframe.operators import joins

    points = spark.createDataFrame([(i, float(i % 4), 0.0) for i in range(40)], "p long, x double, y double")
    ellipses = spark.createDataFrame([(i, 1.0, 0.0, 1.5, 0.5, 0.0) for i in range(20)], "e long, center_x double, center_y double, radius_x double, radius_y double, angle double")
    d = joins.inside_ellipse(points, ellipses, cell=1.0, repeats=True)
    assert d.columns == joins.inside_ellipse(points, ellipses, cell=1.0).columns
    assert sorted((r.p, r.e, r.x) for r in d.collect()) == sorted((i, e, float(i % 4)) for i in range(40) if i % 4 < 3 for e in range(20))


def test_repeated_entries_are_summed_before_a_ring_is_grouped(spark):
    from beatframe.operators import linear

    rows = [(1, c, e, float(c + 2 * e + r)) for c in range(2) for e in range(3) for r in range(4)]
    reg = [(1, e, e, 0.5) for e in range(3)] * 2
    d = linear.operators(spark.createDataFrame(rows, "ring long, channel long, elem_id long, value double"), spark.createDataFrame(reg, "ring long, i long, j long, value double"), h=1.0)
    jac = np.array([[sum(c + 2 * e + r for r in range(4)) for e in range(3)] for c in range(2)], float)
    want = np.linalg.solve(jac.T @ jac + np.eye(3), jac.T)
    assert {(r.elem_id, r.channel): r.value for r in d.collect()} == pytest.approx({(e, c): want[e, c] for e in range(3) for c in range(2)})
    assert planned(d).count("sum(value") >= 2


def test_a_quantile_is_taken_once_for_each_row(spark):
    from beatframe.operators import linear

    d = linear.context(spark.createDataFrame([([3.0, None, -1.0, 2.0],), ([],), (None,), ([4.0],)], "v array<double>"), "v")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") <= 1 and "array_sort(" not in plan
    got = [r.context for r in d.collect()]
    assert got[1:3] == [[], None] and got[3] == [1.0]
