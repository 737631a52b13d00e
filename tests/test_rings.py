"""Operators of many rings in one job, against NumPy frame by frame."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.operators import linear, mesh, rings

NAN, INF = float("nan"), float("inf")
COO = [("a", 0, 0, 1.0), ("a", 1, 1, 1.0), ("a", 5, 1, 2.0), ("a", 5, 1, 3.0), ("a", 7, 9, 1.0), ("a", 8, 0, NAN), ("a", 9, 0, None), ("a", 9, 1, None), ("b", 0, 2, -1.0), ("b", 3, 0, 0.0), ("b", 3, 2, 1.0), (None, 0, 0, 1.0), ("a", None, 0, 1.0), ("a", 4, None, 1.0), ("a", 4, -1, 1.0)]
FRAMES = [(1, "a", [1.0, NAN]), (2, "a", [1.0, None]), (3, "a", [2.0, 3.0, 4.0]), (4, "a", [None, None]), (5, "a", []), (6, "a", None), (7, "b", [INF, 1.0, 2.0]), (8, "b", [1.0]), (9, "c", [1.0]), (10, None, [1.0, 2.0]), (11, "a", [0.0] * 12)]


def one_rule(coo, frames):
    out = {}
    for k, ring, v in frames:
        for r, row, col, value in coo:
            if v is None or r is None or ring != r or row is None or col is None or not 0 <= col < len(v):
                continue
            product = None if value is None or v[col] is None else value * v[col]
            old = out.setdefault((k, row), None)
            out[k, row] = old if product is None else product if old is None else old + product
    return out


def collected(df):
    return {(r["k"], r["row"]): r["y"] for r in df.collect()}


def same(a, b):
    return a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or a[k] == pytest.approx(b[k], nan_ok=True)) for k in a)


@pytest.fixture
def coo(spark):
    return spark.createDataFrame(COO, "ring string, row int, col long, value double")


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(FRAMES, "k long, ring string, v array<double>").repartition(3)


@pytest.mark.parametrize("limit", [rings.MAX_BYTES, 10])
def test_sparse_products_follow_one_rule_on_both_paths(coo, frames, limit, monkeypatch):
    monkeypatch.setattr(rings, "MAX_BYTES", limit)
    d = mesh.apply_sparse(coo, frames, ["k"], "v", ring="ring")
    assert same(collected(d), one_rule(COO, FRAMES)) and d.columns == ["k", "row", "y"]
    only = mesh.apply_sparse(coo.filter("ring = 'a'").drop("ring"), frames.filter("ring = 'a'"), ["k"], "v")
    assert same(collected(only), one_rule(COO, [f for f in FRAMES if f[1] == "a"]))


def test_frames_of_small_matrices_are_not_shuffled(coo, frames):
    plan = mesh.apply_sparse(coo, frames.coalesce(2), ["k"], "v", ring="ring")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_images(coo, frames):
    got = {r["k"]: r["image"] for r in rings.images(coo, frames, ["k"], "v", side=3, ring="ring").collect()}
    want = one_rule(COO, FRAMES)
    assert set(got) == {f[0] for f in FRAMES}
    for k, image in got.items():
        for p in range(9):
            y = want.get((k, p))
            assert math.isnan(image[p]) if y is None or math.isnan(y) else image[p] == pytest.approx(y)
    long = mesh.raster(coo, frames, ["k"], "v", side=3, ring="ring").filter("k = 3").collect()
    assert {(r["row"], r["col"]) for r in long} == {(i, j) for i in range(3) for j in range(3)}


def test_sparse_products_of_many_frames_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 30)) * (rng.random((40, 30)) < 0.2)
    x = rng.normal(size=(500, 30))
    coo = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, value double")
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    got = collected(mesh.apply_sparse(coo, f, ["k"], "v"))
    want = x.astype(np.float32).astype(float) @ m.T
    assert all(y == pytest.approx(want[k], abs=1e-9) for k, y in got.items()) and len(got) == 500 * int(m.any(axis=1).sum())


RAGGED = [(1, "a", [1.0, 2.0, 3.0]), (2, "a", None), (3, "a", [1.0, None, 3.0]), (4, "a", [1.0]), (5, "b", [2.0, 3.0]), (6, "b", [1.0, 2.0, 3.0]), (7, "c", [1.0]), (8, None, [1.0]), (9, "a", [NAN, 1.0, 1.0]), (10, "b", [-1.0, 0.5]), (11, "a", [0.0, 1.0, 0.0])]
MATRIX = {"a": np.array([[1.0, 0.0, 2.0], [0.0, -1.0, 1.0]]), "b": np.array([[1.0, 1.0], [2.0, 0.0], [0.0, 3.0]])}


def expected(ring, v):
    m = MATRIX.get(ring)
    return None if m is None or v is None or len(v) != m.shape[1] or None in v else m @ np.array(v)


def test_dense_products_give_null_where_a_vector_does_not_fit(spark):
    df = spark.createDataFrame(RAGGED, "k long, ring string, v array<double>").coalesce(1)
    for r in linear.times(df, "v", MATRIX, "y", ring="ring").collect():
        want = expected(r.ring, r.v)
        assert r.y is None if want is None else r.y == pytest.approx(want.tolist(), nan_ok=True)
    one = {r.k: r.y for r in linear.times(df, "v", MATRIX["a"], "y").collect()}
    assert one[1] == [7.0, 1.0] and one[2] is one[3] is one[4] is one[5] is None and one[6] == [7.0, 1.0]
    assert linear.times(df.filter("false"), "v", MATRIX, "y", ring="ring").count() == 0


def test_linear_operators_of_all_rings(spark):
    df = spark.createDataFrame([(*r, [1.0, 2.0] if r[1] == "a" else [1.0, 2.0, -1.0]) for r in RAGGED], "k long, ring string, v array<double>, volt array<double>")
    inverse = {r: np.arange(m.size).reshape(m.T.shape) / 10 for r, m in MATRIX.items()}
    for r in linear.directions(df, voltage="volt", state="v", jacobian=MATRIX, inverse=inverse, ring="ring").collect():
        f = expected(r.ring, r.v)
        assert r.direction is None if f is None else r.direction == pytest.approx((inverse[r.ring] @ (np.array(r.volt) - f)).tolist(), nan_ok=True)
    for r in linear.first_step(df, voltage="volt", jacobian=MATRIX, inverse=inverse, ring="ring").collect():
        if r.ring in MATRIX:
            step = inverse[r.ring] @ np.array(r.volt)
            assert r.step == pytest.approx(step.tolist()) and r.residual_after == pytest.approx(np.sqrt(np.mean((r.volt - MATRIX[r.ring] @ step) ** 2)))
        else:
            assert r.step is None and r.residual_after is None
    scores = {r.k: (r.valid, r.score) for r in linear.batch_scores(df, MATRIX, vector="v", order="k", by=["ring"], ring="ring").collect()}
    assert [k for k, v in scores.items() if v[0]] and {k for k, v in scores.items() if v[0]} == {1, 5, 10, 11} and scores[9] == (False, None) and scores[5][1] == [5.0, 4.0, 9.0]
    residual = {r.ring: (r.residual_rms, r.clipped) for r in linear.dataset_residual(df.filter("k <> 9"), state="v", voltage="volt", jacobian=MATRIX, floor=0.5, ring="ring").collect()}
    want = np.concatenate([np.array([1.0, 2.0]) - MATRIX["a"] @ np.maximum(v, 0.5) for k, g, v in RAGGED if g == "a" and k in (1, 11)])
    assert residual["a"] == (pytest.approx(np.sqrt(np.mean(want**2))), 2) and residual["c"][0] is None


def test_operators_by_ring_from_a_table(spark, monkeypatch):
    rows = [(g, int(i), int(j), float(m[i, j])) for g, m in MATRIX.items() for i, j in zip(*np.nonzero(m))]
    table = spark.createDataFrame(rows, "ring string, elem_id int, channel int, value double")
    got = rings.dense_by_ring(table, "elem_id", "channel")
    assert got.keys() == MATRIX.keys() and all((got[g] == MATRIX[g]).all() for g in MATRIX)
    monkeypatch.setattr(rings, "MAX_BYTES", 30)
    with pytest.raises(ValueError):
        rings.dense_by_ring(table, "elem_id", "channel")
    with pytest.raises(ValueError):
        linear.times(table.withColumn("v", F.array("value")), "v", MATRIX, "y", ring="ring")
