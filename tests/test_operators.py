"""Golden values, invariants and NumPy versions of the operators that SQL does not cover."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.functions.quantiles import exact_percentiles, with_percentiles
from beatframe.operators import checks, corpus, joins, linear, mesh, metrics, projections, rings, select, signals, templates
from beatframe.sources import io
from beatframe.streaming import frames as streaming


def recording(spark, values, session="s"):
    return spark.createDataFrame([(session, i, float(v)) for i, v in enumerate(values)], "session string, frame_no long, x double")


def column(df, c, order="frame_no"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_moving_mean_of_an_even_window(spark):
    d = recording(spark, range(1, 7)).withColumn("m", signals.moving_mean("x", by=["session"], order="frame_no", window=4))
    assert column(d, "m") == [1.5, 2, 2.5, 3.5, 4.5, 5]


def test_differences(spark):
    d = signals.second_difference(recording(spark, range(5)), "x", by=["session"], order="frame_no")
    assert column(d, "d") == [0, 1, 1, 1, 0]
    assert column(d, "dd") == [0, 0.5, 0, -0.5, 0]


def test_two_frames_have_no_difference(spark):
    assert column(signals.second_difference(recording(spark, [3, 9]), "x", by=["session"], order="frame_no"), "d") == [0, 0]


def test_voltage_sign(spark):
    d = spark.createDataFrame([([-2.0, 0.0, 3.0],)], "r array<double>")
    assert projections.resistance_to_voltage(d, "r").first()["voltage"] == pytest.approx([-0.02, 0.0, 0.03])


def test_components_add_up_and_are_cropped_after_filtering(spark):
    x = np.sin(np.arange(350) / 9) + np.arange(350) / 100
    d = signals.decompose_and_retain(recording(spark, x), by=["session"], order="frame_no")
    w = d.groupBy("frame_no").pivot("component").agg(F.first("value")).orderBy("frame_no").toPandas()
    assert w["frame_no"].tolist() == list(range(250))
    assert np.allclose(w["hp"] + w["lp"], x[50:300] - x[50])


def test_sessions_by_file_name(spark):
    d = spark.createDataFrame([("/a/S006_rest2.h5",), ("/a/other.txt",)], "path string")
    assert [tuple(r) for r in io.sessions(d).select("subject", "session", "number", "session_rank").collect()] == [("s006", "rest", 2, 1)]


def test_ring_labels(spark):
    d = spark.createDataFrame([("6",), ("10.5",), ("13",), ("99",), ("x",)], "s string").select(projections.ring_label(F.col("s")).alias("r"))
    assert [r["r"] for r in d.collect()] == ["US060", "US105", "US130", None, None]


# -- checks


def good_frames(spark, fpb=50, beats=5, anatomies=2):
    rows = [(a, a * 5 + b, s, (a * beats + b) * fpb + s, [0.0 if b == s == 0 else 1.0 + s, -1.0], [1.0, 2.0]) for a in range(anatomies) for b in range(beats) for s in range(fpb)]
    return spark.createDataFrame(rows, "anatomy_id long, beat_id long, sample_index long, frame_no long, v array<double>, template array<double>")


def passed(df):
    return df.agg(F.bool_and("passed")).first()[0]


def test_a_good_pack_passes(spark):
    f = good_frames(spark)
    for c in (checks.row_count(f, 250), checks.anatomy_complete(f), checks.beat_complete(f), checks.stored_in_order(f, position="frame_no"), checks.constant_within(f, "template", by="beat_id", order="sample_index"), checks.finite_values(f, "v"), checks.width(f, "v", 2)):
        assert passed(c)
        checks.assert_passed(c)


@pytest.mark.parametrize("bad", ["short", "swapped", "nan", "template", "leak"])
def test_each_bad_pack_fails_its_check(spark, bad):
    f = good_frames(spark)
    if bad == "short":
        c = checks.beat_complete(f.filter("not (beat_id = 3 and sample_index = 7)"))
    elif bad == "swapped":
        c = checks.stored_in_order(f.withColumn("frame_no", F.when((F.col("beat_id") == 3) & (F.col("sample_index") == 7), 1e6).otherwise(F.col("frame_no"))), position="frame_no")
    elif bad == "nan":
        c = checks.finite_values(f.withColumn("v", F.when(F.col("frame_no") == 9, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("v"))), "v")
    elif bad == "template":
        c = checks.constant_within(f.withColumn("template", F.when(F.col("frame_no") == 9, F.array(F.lit(1.0), F.lit(2.1))).otherwise(F.col("template"))), "template", by="beat_id", order="sample_index")
    else:
        c = checks.split_leakage(f.withColumn("split", F.when(F.col("frame_no") == 9, "test").otherwise("train")), "anatomy_id", "split")
    assert not passed(c)
    with pytest.raises(ValueError):
        checks.assert_passed(c)


def test_empty_pack(spark):
    f = good_frames(spark).limit(0)
    assert not passed(checks.row_count(f, 250))
    assert passed(checks.finite_values(f, "v"))


def test_split_sizes_and_disjointness(spark):
    s = select.split_ids(spark.range(200).withColumnRenamed("id", "anatomy_id"), {"train": 160, "validation": 20, "test": 20}, seed=3)
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 160, "validation": 20, "test": 20}
    assert s.select("anatomy_id").distinct().count() == 200


# -- sparse and mesh


def test_categorical_raster(spark):
    rows = [[0.3, 0.7, 0], [0.6, 0.4, 0], [0, 0, 0], [0, 0, 1]]
    coo = spark.createDataFrame([(r, c, float(v)) for r, x in enumerate(rows) for c, v in enumerate(x)], "row long, col long, value double")
    labels = spark.createDataFrame([(0, 3), (1, 5), (2, 4)], "elem_id long, label int")
    p = {r["p"]: r["label"] for r in mesh.categorical_raster(coo, labels, background=0, pixels=4).collect()}
    assert [[p[c * 2 + r] for c in range(2)] for r in range(2)] == [[5, 0], [3, 4]]


def cut(corners, box):
    """Area of a polygon inside a box, by cutting it along the four sides."""
    poly = list(corners)
    for axis, bound, sign in ((0, box[0], 1), (0, box[1], -1), (1, box[2], 1), (1, box[3], -1)):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            x, y = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if x >= 0:
                out.append(p)
            if x * y < 0:
                out.append(tuple(p[i] + x / (x - y) * (q[i] - p[i]) for i in (0, 1)))
        poly = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2


def test_clipped_area(spark):
    rng = np.random.default_rng(4)
    cases = [([(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], box) for box in ((0.0, 1.0, 0.0, 1.0), (0.0, 2.0, 0.0, 2.0), (3.0, 4.0, 0.0, 1.0))]
    for _ in range(300):
        x, y = np.sort(rng.uniform(-1, 1, (2, 2)))
        cases.append(([tuple(map(float, p)) for p in rng.uniform(-1.5, 1.5, (3, 2)).round(1)], (x[0], x[1], y[0], y[1])))
    d = spark.createDataFrame([([list(p) for p in t], *map(float, box)) for t, box in cases], "c array<array<double>>, x0 double, x1 double, y0 double, y1 double")
    got = [r["a"] for r in d.select(mesh.clipped_area(F.col("c"), *[F.col(n) for n in ("x0", "x1", "y0", "y1")]).alias("a")).collect()]
    assert got == pytest.approx([cut(t, box) for t, box in cases], abs=1e-12)
    assert got[:3] == pytest.approx([1.0, 2.0, 0.0])


def test_image_map_rows_sum_to_one(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, True), (1, 2.0, 0.0, True), (2, 2.0, 2.0, True), (3, 0.0, 2.0, True)], "node_id long, x double, y double, is_boundary boolean")
    elements = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "elem_id long, n0 long, n1 long, n2 long")
    m = mesh.image_map(nodes, elements, 2, cell=1.0)
    assert passed(checks.unit_row_sums(m))
    assert m.select("row").distinct().count() == 4


def test_grid_components(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 5, 5), (1, 9, 9), (1, 9, 8), (1, 8, 9)], "frame long, row int, col int")
    assert [(r["rank"], r["size"]) for r in mesh.grid_components(cells, "frame").orderBy("rank").collect()] == [(1, 3), (2, 2)]


def test_ellipse_join_needs_no_all_pairs(spark):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(0).uniform(-1, 1, (200, 2)))], "elem_id long, x double, y double")
    e = spark.createDataFrame([(0.1, 0.2, 0.5, 0.2, 0.7)], "center_x double, center_y double, radius_x double, radius_y double, angle double")
    got = {r["elem_id"] for r in joins.inside_ellipse(p, e, cell=0.3).collect()}
    t = p.toPandas()
    u, v = (t.x - 0.1) * np.cos(0.7) + (t.y - 0.2) * np.sin(0.7), (t.y - 0.2) * np.cos(0.7) - (t.x - 0.1) * np.sin(0.7)
    assert got == set(t.elem_id[(u / 0.5) ** 2 + (v / 0.2) ** 2 <= 1])


# -- linear and templates


def test_operators_solve_each_ring(spark):
    rng = np.random.default_rng(1)
    jac = rng.normal(size=(4, 6))
    j = spark.createDataFrame([("a", c, e, float(jac[c, e])) for c in range(4) for e in range(6)], "ring string, channel long, elem_id long, value double")
    r = spark.createDataFrame([("a", i, i, 1.0) for i in range(6)], "ring string, i long, j long, value double")
    m = linear.dense(linear.operators(j, r, h=0.3, sign=-1.0), "elem_id", "channel")
    assert np.allclose(m, -np.linalg.solve(jac.T @ jac + 0.09 * np.eye(6), jac.T))


@pytest.mark.parametrize("null_mode", [False, True])
def test_frame_solves(spark, null_mode):
    rng = np.random.default_rng(2)
    lap = 2 * np.eye(9) - np.eye(9, k=1) - np.eye(9, k=-1)
    lap[0, 0] = lap[-1, -1] = 1 if null_mode else 2
    values, vectors = np.linalg.eigh(lap)
    jac, r = rng.normal(size=(3, 9)), rng.normal(size=3)
    d = spark.createDataFrame([(1, jac.tolist(), r.tolist())], "k long, j array<array<double>>, r array<double>")
    row = linear.frame_solves(d, key="k", jacobian="j", residual="r", eigenvalues=values, eigenvectors=vectors).first()
    assert np.allclose(row["step"], np.linalg.solve(jac.T @ jac + lap, jac.T @ r), atol=1e-6)
    assert row["backward_error"] <= 1e-7


def test_batch_scores_mark_bad_frames(spark):
    d = spark.createDataFrame([("s", 0, [1.0, 2.0]), ("s", 1, [1.0]), ("s", 2, [float("nan"), 1.0])], "session string, frame_no long, v array<double>")
    rows = linear.batch_scores(d, np.array([[1.0, 1.0]]), vector="v", order="frame_no", by=["session"]).orderBy("frame_no").collect()
    assert [(r["valid"], r["score"]) for r in rows] == [(True, [3.0]), (False, None), (False, None)]


def test_zero_phase_filter():
    t = np.arange(500) / 50
    slow, fast = np.sin(2 * np.pi * 1.0 * t), np.sin(2 * np.pi * 20 * t)
    y = templates.zero_phase(slow + fast, 50.0)
    assert np.abs(y - slow)[50:-50].max() < 0.02
    assert np.allclose(templates.zero_phase(np.full(40, 3.0), 50.0), 3.0)
    with pytest.raises(ValueError):
        templates.zero_phase(np.ones(12), 50.0)
    with pytest.raises(ValueError):
        templates.butterworth(3, 30.0, 50.0)


def test_beat_template_is_the_leading_mode(spark):
    pattern, wave = np.array([1.0, -2.0, 0.5]), np.sin(np.arange(50) / 8)
    rows = [(0, i, (wave[i] * pattern + 4).tolist()) for i in range(50)]
    d = spark.createDataFrame(rows, "beat_id long, sample_index long, v array<double>")
    got = np.array(templates.beat_templates(d, "v", by=["beat_id"], order="sample_index").first()["template"])
    w = -pattern / np.linalg.norm(pattern)  # its largest loading is made positive
    assert np.allclose(got, ((wave - wave.mean())[:, None] * pattern @ w).max() * w)


def test_correlation_of_a_constant_is_nan(spark):
    d = spark.createDataFrame([([1.0, 1.0], [1.0, 2.0])], "pred array<double>, truth array<double>")
    assert np.isnan(metrics.error_metrics(metrics.pooled(metrics.frame_sums(d), [])).first()["correlation"])


def test_groups_of_any_size_have_exact_percentiles(spark):
    rng = np.random.default_rng(7)
    values = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0], 500), "c": [4.0], None: rng.normal(size=40)}
    d = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("d", None)], "k string, x double")
    got = {r["k"]: (r["low"], r["mid"], r["top"]) for r in exact_percentiles(d, ["k"], "x", {"low": 0.005, "mid": 0.5, "top": 1.0}, accuracy=100).collect()}
    assert "d" not in got
    few = d.groupBy("k").count()
    assert with_percentiles(few, d, ["k"], "x", {"mid": 0.5}).filter("k = 'd' and mid is null and count = 1").count() == 1 and with_percentiles(few, d, ["k"], "x", {"mid": 0.5}).count() == 5
    for k, v in values.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.005, 0.5, 1.0])))


@pytest.mark.parametrize("block", [1000, 7])
def test_nearest_entry_over_blocks(spark, block):
    rng = np.random.default_rng(3)
    x, m = rng.normal(size=(40, 5)), rng.normal(size=(60, 5)).round(1)
    m[30:] = m[:30]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "b long, w array<double>")
    got = {r["k"]: (r["b"], r["distance"]) for r in joins.nearest(d, bank, key="k", vector="v", bank_key="b", bank_vector="w", block=block).collect()}
    far = np.square(x[:, None] - m[None]).mean(axis=2)
    assert [got[i][0] for i in range(40)] == far.argmin(axis=1).tolist()
    assert [got[i][1] for i in range(40)] == pytest.approx(far.min(axis=1))
    assert joins.nearest(d, bank.limit(0), key="k", vector="v", bank_key="b", bank_vector="w").filter("b is null").count() == 40


def test_large_matrices_are_joined_instead(spark, monkeypatch):
    rng = np.random.default_rng(5)
    coo = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 9, 30), rng.integers(0, 6, 30), rng.normal(size=30))], "row long, col long, value double")
    f = spark.createDataFrame([(i, rng.normal(size=4 + i % 3).tolist()) for i in range(10)], "k long, v array<double>")
    small = {(r["k"], r["row"]): r["y"] for r in mesh.apply_sparse(coo, f, ["k"], "v").collect()}
    monkeypatch.setattr(rings, "MAX_BYTES", 10)
    large = {(r["k"], r["row"]): r["y"] for r in mesh.apply_sparse(coo, f, ["k"], "v").collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)


def test_template_modes(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 4)) + 3
    t, w = templates.rank_one(v)
    assert np.allclose(templates.template(v, "row"), np.outer(t, w)[np.abs(t).argmax()])
    assert np.allclose(templates.template(np.full((50, 4), 2.5), "row"), 0) and np.allclose(templates.template(np.full((50, 4), 2.5), "absolute"), 0)


def test_blockwise_filter_equals_the_recursion():
    b, a = templates.butterworth(3, 5.0, 50.0)
    x, z = np.random.default_rng(8).normal(size=1000), np.array([0.3, -0.2, 0.1])
    state, want = z.copy(), []
    for v in x:
        y = b[0] * v + state[0]
        state = np.append(state[1:], 0.0) + b[1:] * v - a[1:] * y
        want.append(y)
    got, after = templates.run_filter(b, a, x, z)
    assert np.allclose(got, want) and np.allclose(after, state)


def test_calibration_of_a_silent_reference(spark):
    d = spark.createDataFrame([([4.0, 0.0], [2.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [0.0, 0.0], [1.0, 1.0])], "v array<double>, r array<double>, m array<double>")
    rows = linear.calibrated(d, voltage="v", reference="r", model0="m").collect()
    assert [(r["alpha"], r["differential"]) for r in rows] == [(0.5, [2.0, 0.0]), (1.0, [1.0, 1.0])]


def test_a_turned_vessel_holds_what_lies_along_it(spark):
    p = spark.createDataFrame([(0, 0.0, 0.4), (1, 0.4, 0.0), (2, 0.0, 1.2)], "elem_id long, x double, y double")
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.1, float(np.pi / 2))], "frame long, slot int, center_x double, center_y double, radius_x double, radius_y double, angle double")
    rows = {r["elem_id"]: r for r in mesh.vessel_targets(p, v, "frame").collect()}
    assert rows[0]["hard"] and not rows.get(1, {"hard": False})["hard"] and not rows[2]["hard"]
    assert rows[0]["soft"] == pytest.approx([np.exp(-0.5 * 0.64 / 1.25**2), 0.0]) and rows[2]["soft"][0] == pytest.approx(np.exp(-0.5 * 5.76 / 1.25**2))


# -- sources


def test_npz_rows_and_missing_fields(spark, tmp_path):
    np.savez(tmp_path / "a.npz", V=np.arange(6.0).reshape(3, 2), anatomy_id=np.array([1, 1, 2]))
    d = io.read_npz(spark, str(tmp_path), {"V": "array<double>", "anatomy_id": "bigint", "V_template": "array<double>"})
    rows = io.defaulted(d, "V_template", "V").orderBy("row").collect()
    assert [(r["anatomy_id"], r["V"], r["V_template"]) for r in rows] == [(1, [0.0, 1.0], [0.0, 1.0]), (1, [2.0, 3.0], [2.0, 3.0]), (2, [4.0, 5.0], [4.0, 5.0])]


def test_records_and_reports(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"anatomy_id": 1, "vessels": [{"radius": 2.0}]}]))
    assert io.read_records(spark, str(tmp_path / "x.json")).first()["vessels"][0]["radius"] == 2.0
    for name in ("e1", "e2"):
        (tmp_path / name / "evaluation").mkdir(parents=True)
        (tmp_path / name / "evaluation" / "report.json").write_text(json.dumps({"score": 1}))
    d = io.read_reports(spark, str(tmp_path / "*" / "evaluation" / "report.json"))
    assert {r["experiment"] for r in d.collect()} == {"e1", "e2"}


def test_csv_ignores_extra_fields_and_appends(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "x")], "id int, name string, more string")
    for _ in range(2):
        io.write_csv(d, str(tmp_path / "t"), ["id", "name"], append=True)
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "t"), ["name"]).collect()] == [("a",), ("a",)]


def test_write_once_and_partitions(spark, tmp_path):
    d = spark.createDataFrame([("US060", "train", 1), ("US065", "test", 2)], "ring string, split string, x int")
    path = str(tmp_path / "corpus")
    io.write_once(d, path, ["ring", "split"])
    assert io.read_complete(spark, path).filter("ring = 'US060'").select("x").collect() == [(1,)]
    with pytest.raises(Exception, match="exists"):
        io.write_once(d, path, ["ring", "split"])
    (tmp_path / "corpus" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="incomplete"):
        io.read_complete(spark, path)


def test_fingerprints(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert io.file_fingerprints(spark, str(tmp_path / "f.bin")).first()["sha256"].startswith("ba7816bf")
    d = recording(spark, range(100))
    assert io.value_fingerprint(d, ["frame_no"], ["x"]).first() == io.value_fingerprint(d.repartition(7), ["frame_no"], ["x"]).first()


# -- streams


def stream(spark, tmp_path, frames, job):
    """Runs a streaming job over the frames in several files, then over another session's frame long after, and gives the first session's rows."""
    source, at = tmp_path / "in", tmp_path / "out"
    for i in range(4):
        frames.filter(F.floor(F.col("frame_no") / 40) == i).coalesce(1).write.parquet(f"{source}/part{i}")
    for i in (4, 5):
        frames.filter("frame_no = 0").withColumn("session", F.lit("later")).withColumn("frame_no", F.lit(i).cast("long")).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(i))).coalesce(1).write.parquet(f"{source}/part{i}")
    s = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part*")
    q = job(streaming.accepted(s)).writeStream.format("parquet").option("path", str(at)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(str(at))
    return out.filter("session = 's'") if "session" in out.columns else out


@pytest.fixture(scope="module")
def live(spark):
    """160 frames; the files that stream() cuts overlap in time, as frames 30 to 49 come in the order of their last digit."""
    at = lambda i: 30 + 2 * (i - 30) if 30 <= i < 40 else 31 + 2 * (i - 40) if 40 <= i < 50 else i
    rows = [("s", i, datetime(2024, 1, 1) + timedelta(milliseconds=20 * at(i)), [float(np.sin(i / 5)), float(i)], i == 70) for i in range(160)]
    return spark.createDataFrame(rows, "session string, frame_no long, ts timestamp, v array<double>, reset boolean")


def test_streamed_buffers(spark, tmp_path, live):
    rows = stream(spark, tmp_path, live, lambda d: streaming.buffers(d, size=50)).orderBy("buffer").collect()
    assert [(r["buffer"], r["first_frame"], r["frames"]) for r in rows] == [(0, 0, 50), (1, 50, 50), (2, 100, 50), (3, 150, 10)]
    assert [n for r in rows for n in r["numbers"]] == list(range(160)) and [v[1] for r in rows for v in r["values"]] == list(range(160))


def test_streamed_epochs_equal_the_batch(spark, tmp_path, live):
    got = stream(spark, tmp_path, live, lambda d: streaming.epochs(d, size=60)).orderBy("frame_no").toPandas()
    x = live.select("session", "frame_no", F.col("v")[1].alias("x"), "reset")
    want = signals.reference_epochs(x, by=["session"], order="frame_no", reset="reset", size=60).orderBy("frame_no").toPandas()
    assert np.allclose(np.stack(got["delta"])[:, 1], want["delta"])


def test_streamed_filter_equals_one_pass(spark, tmp_path, live):
    got = stream(spark, tmp_path, live, lambda d: streaming.causal_lowpass(d, rate=50.0)).orderBy("frame_no").toPandas()
    b, a = templates.butterworth(3, 5.0, 50.0)
    x = np.sin(np.arange(160) / 5)
    assert np.allclose(np.stack(got["filtered"])[:, 0], templates.run_filter(b, a, x, templates.steady_state(b, a) * x[0])[0])
    assert got["valid"].tolist() == [i >= 50 for i in range(160)]


def test_streamed_scores_equal_the_batch(spark, tmp_path, live):
    m = np.array([[1.0, 2.0]])
    got = stream(spark, tmp_path, live, lambda d: streaming.scored(d, m).select("session", "frame_no", "score")).orderBy("frame_no").toPandas()
    want = streaming.scored(live, m).orderBy("frame_no").toPandas()
    assert np.allclose(np.stack(got["score"]), np.stack(want["score"]))


def test_streamed_buffers_are_scored_in_order(spark, tmp_path, live):
    m = np.array([[1.0, 2.0]])
    rows = stream(spark, tmp_path, live, lambda d: streaming.scored_buffers(streaming.buffers(d, size=50), m)).orderBy("buffer").collect()
    assert all(r["valid"] for r in rows)
    assert np.allclose([s[0] for r in rows for s in r["scores"]], [np.sin(i / 5) + 2 * i for i in range(160)])
