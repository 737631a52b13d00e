"""Filters, means and templates in parts equal those over whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.operators import blocks, signals, templates

NAN = float("nan")


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(8)
    rows = [("long", int(i), float(x)) for i, x in enumerate(np.cumsum(rng.normal(size=1000)))]
    rows += [("gaps", int(3 * i + 70 * (i // 50)), float(x)) for i, x in enumerate(rng.normal(size=400))]
    rows += [("short", i, 1.0) for i in range(12)] + [("least", i, float(i % 5)) for i in range(13)] + [(None, i, float(i)) for i in range(100)]
    rows += [("negative", i - 150, float(np.sin(i / 9))) for i in range(300)]
    return spark.createDataFrame(rows, "g string, n long, x double").repartition(5).cache(), rows


@pytest.mark.parametrize("block", [16, 64, 10_000])
def test_lowpass_equals_the_whole_recording(recordings, block):
    df, rows = recordings
    got = {}
    for r in blocks.lowpass(df, "x", by=["g"], order="n", rate=50.0, block=block).collect():
        got.setdefault(r.g, []).append((r.n, r.x, r.filtered))
    assert got.keys() == {g for g, _, _ in rows}
    for g, v in got.items():
        v.sort()
        mine = sorted((n, x) for k, n, x in rows if k == g)
        assert [(n, x) for n, x, _ in v] == mine
        want = templates.zero_phase(np.array([x for _, x in mine]), 50.0) if len(mine) > 12 else np.full(len(mine), NAN)
        assert np.allclose([y for *_, y in v], want, atol=1e-9, equal_nan=True)


def test_no_task_holds_more_than_a_block(recordings):
    df, _ = recordings
    d = df.groupBy("g", F.floor(F.col("n") / 64)).count().agg(F.max("count")).first()[0]
    assert d <= 64


def test_lowpass_of_null_samples_and_no_rows(spark):
    df = spark.createDataFrame([("a", i, None if i == 20 else 1.0) for i in range(40)] + [("b", i, 2.0) for i in range(20)], "g string, n int, x double")
    got = blocks.lowpass(df, "x", by=["g"], order="n", rate=50.0, block=8)
    assert got.filter("g = 'a' and isnan(filtered)").count() > 0 and got.filter("g = 'b' and abs(filtered - 2) < 1e-9").count() == 20
    assert blocks.lowpass(df.filter("false"), "x", by=["g"], order="n", rate=50.0).count() == 0
    with pytest.raises(ValueError):
        blocks.lowpass(df, "x", by=["g"], order="n", rate=9.0)


@pytest.mark.parametrize("block, window", [(16, 7), (64, 100), (5, 8), (10_000, 8)])
def test_moving_mean_equals_one_window(recordings, block, window):
    df, _ = recordings
    got = {(r.g, r.n): r.lp for r in blocks.moving_mean(df, "x", by=["g"], order="n", window=window, block=block).collect()}
    want = {(r.g, r.n): r.lp for r in df.withColumn("lp", signals.moving_mean("x", by=["g"], order="n", window=window)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_group_templates_equal_the_singular_vectors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g, n in (("a", 300), ("b", 2), ("c", 1), (None, 40)):
        base = rng.normal(size=6)
        rows += [(g, (base * rng.uniform(0.5, 2) + 0.3 * rng.normal(size=6)).tolist()) for _ in range(n)]
    extra = [("a", None), ("b", [None] * 6)]
    df = spark.createDataFrame(rows + extra, "g string, template array<double>").repartition(7)
    got = {r.g: np.array(r.template) for r in templates.group_templates(df, "g").collect()}
    for g in ("a", "b", "c", None):
        v = np.array([t for k, t in rows if k == g])
        size = np.linalg.norm(v, axis=1)
        unit = v / size[:, None]
        w = np.linalg.svd(unit, full_matrices=False)[2][0]
        w = w if w @ unit.sum(axis=0) >= 0 else -w
        assert np.allclose(got[g], w * np.median(size), atol=1e-8)
    plan = templates.group_templates(df, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
