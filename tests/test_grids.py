"""Range joins over grids of several sizes, and fingerprints that don't grow."""

import random

from pyspark.sql import functions as F

from beatframe.operators import joins
from beatframe.sources import io

BOX = "k long, x0 double, x1 double, y0 double, y1 double"


def boxes(rng, n, sizes):
    out = []
    for i in range(n):
        x, y, s = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice(sizes)
        out.append((i, x, x + s * rng.random(), y, y + s * rng.random()))
    return out


def test_boxes_of_all_sizes(spark):
    rng = random.Random(1)
    a = boxes(rng, 150, [0.01, 1, 4, 30, 1e5]) + [(900, 0.0, 0.0, 0.0, 0.0), (901, None, 1.0, 0.0, 1.0), (902, -4.0, 4.0, -4.0, 4.0), (902, -4.0, 4.0, -4.0, 4.0)]
    b = boxes(rng, 150, [0.5, 2, 60, 3000, 1e7]) + [(902, 4.0, 8.0, -4.0, 4.0), (903, -1.0, 1.0, -1.0, 1.0)]
    got = sorted((r.k, r.b_k) for r in joins.box_overlap(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), cell=4.0).select("k", "b_k").collect())
    meets = lambda p, q: None not in p + q and p[1] < q[2] and q[1] < p[2] and p[3] < q[4] and q[3] < p[4]
    assert got == sorted((p[0], q[0]) for p in a for q in b if meets(p, q))


def test_points_in_ellipses_of_all_sizes(spark):
    import math

    rng = random.Random(2)
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)]
    e = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.1, 3.0, 40.0, 2e6]), rng.choice([0.2, 2.0, 9.0]), rng.uniform(0, 3)) for i in range(60)]
    d = joins.inside_ellipse(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(e, "e long, center_x double, center_y double, radius_x double, radius_y double, angle double"), cell=1.0)
    got = sorted((r.p, r.e) for r in d.collect())

    def inside(p, q):
        dx, dy = p[1] - q[1], p[2] - q[2]
        u, v = dx * math.cos(q[5]) + dy * math.sin(q[5]), dy * math.cos(q[5]) - dx * math.sin(q[5])
        return (u / q[3]) ** 2 + (v / q[4]) ** 2 <= 1

    assert got == sorted((p[0], q[0]) for p in points for q in e if inside(p, q))
    assert joins.inside_ellipse(d.select("p", "x", "y").limit(0), d.select("e", "center_x", "center_y", "radius_x", "radius_y", "angle").limit(0), cell=1.0).count() == 0


def test_a_large_object_lies_in_few_cells(spark):
    """One that covers a million cells of the finest grid."""
    one = spark.createDataFrame([(1, 0.3, 1000.3, 0.3, 1000.3)], BOX).withColumn("_own", joins.level(F.col("x1") - F.col("x0"), 1.0))
    assert joins.entered(one, [0, 3, 10, 12], "x0", "x1", "y0", "y1", cell=1.0, own_only=True).count() <= 4
    assert joins.entered(one, [0, 3, 10, 12], "x0", "x1", "y0", "y1", cell=1.0, own_only=False).count() <= 8


def test_fingerprint_of_rows_in_any_order(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 else float(i)) for i in range(500)]
    d = spark.createDataFrame(rows, "k long, a string, b double")
    of = lambda x: io.value_fingerprint(x, ["k"], ["a", "b"]).first()
    assert of(d) == of(d.repartition(9).orderBy(F.desc("k"))) and of(d).rows == 500
    assert of(d) != of(d.filter("k > 0")) != of(d.unionByName(d.filter("k = 3")))
    assert of(d) != of(d.withColumn("a", F.when(F.col("k") == 8, "x").otherwise(F.col("a"))))
    two = lambda a, b: io.value_fingerprint(spark.createDataFrame([(a, b)], "a string, b string"), ["a"], ["b"]).first()
    assert two("x|1:y", "z") != two("x", "y|1:z") and two(None, "null") != two("null", None) and two("", None) != two(None, "")
    assert of(d.filter("false")).rows == 0
    plan = io.value_fingerprint(d, ["k"], ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_a_mesh_too_large_to_send_is_refused(spark, monkeypatch):
    import pytest

    from beatframe.operators import mesh

    positions = spark.range(20).select(F.col("id").alias("elem_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    assert mesh.mesh_points(positions).count() == 1
    monkeypatch.setattr(mesh, "MAX_BYTES", 240)
    with pytest.raises(ValueError):
        mesh.mesh_points(positions)


def test_shares_of_a_stage_that_is_absent_are_null(spark):
    from beatframe.operators import rollup

    d = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 1.0])], "stage string, v array<double>")
    assert [(r.stage, r.share) for r in rollup.activation(d, "v", "stage", reference="none").orderBy("stage").collect()] == [("a", None), ("b", None)]
    assert rollup.activation(d, "v", "stage", reference="a").filter("stage = 'a' and share = 1").count() == 1
