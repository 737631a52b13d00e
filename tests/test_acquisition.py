"""Acquisition effects: sizes, independence of one another and of partitions, odd rows."""

import numpy as np
import pytest

from beatframe.operators import acquisition
from beatframe.operators.acquisition import Instrument

OFF = Instrument(0, 0, 0, 0, 0, 0, 0, 0, 0)


def only(**k):
    return Instrument(**{**dict.fromkeys(Instrument.__dataclass_fields__, 0.0), **k})


@pytest.fixture(scope="module")
def clean():
    return np.random.default_rng(0).normal(size=(400, 6)) * np.array([1, 1, 1, 1, 1, 100.0]) + 5


@pytest.fixture(scope="module")
def df(spark, clean):
    return spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(clean)], "k string, n long, v array<double>").cache()


def run(df, instrument, seed=3):
    frames, done = acquisition.augment(df, "v", key="k", order="n", seed=seed, instrument=instrument)
    return np.array([r.augmented for r in frames.orderBy("n").collect()]), done.first()


def test_nothing_is_done_where_all_sizes_are_zero(df, clean):
    y, done = run(df, OFF)
    assert np.allclose(y, clean) and done.current_gain == 1 and done.channel_gain == [1.0] * 6 and done.artifact_events == [] and done.static_offset == [0.0] * 6


def test_gains_and_offsets_are_those_told(df, clean):
    y, done = run(df, only(channel_gain=0.1, current_gain=0.1, offset=0.01))
    assert np.allclose(y, clean * done.current_gain * np.array(done.channel_gain) + np.array(done.static_offset))
    size = np.sqrt((clean**2).mean(axis=0))
    assert (np.abs(done.static_offset) < 0.05 * size).all() and len(set(done.channel_gain)) == 6


def test_white_noise_scales_with_each_channel(df, clean):
    y, _ = run(df, only(white=0.1))
    assert (y - clean).std(axis=0) / clean.std(axis=0) == pytest.approx(np.full(6, 0.1), rel=0.2)
    assert abs(np.corrcoef((y - clean)[:, 0], (y - clean)[:, 1])[0, 1]) < 0.2
    y, _ = run(df, only(floor=0.5))
    assert (y - clean).std(axis=0) == pytest.approx(np.full(6, 0.5), rel=0.2)


def test_drift_is_smooth_and_common_noise_has_one_direction(df, clean):
    y, done = run(df, only(drift=0.01))
    size, d = np.sqrt((clean**2).mean(axis=0)), y - clean
    assert np.abs(d / (0.01 * size * np.array(done.drift_spatial))).max() <= 1 + 1e-9 and np.abs(np.diff(d[:, 0], 2) > 1e-9).sum() <= 9
    assert np.linalg.matrix_rank(d, tol=1e-8) == 1
    y, done = run(df, only(common=0.01))
    d = y - clean
    assert np.linalg.matrix_rank(d, tol=1e-8) == 1 and np.linalg.norm(done.correlated_spatial) == pytest.approx(1)
    assert np.abs(d @ np.array(done.correlated_spatial)).max() == pytest.approx(0.01 * np.linalg.norm(clean.std(axis=0)), rel=0.05)


def test_jumps_are_those_told(df, clean):
    for seed in range(4):
        y, done = run(df, only(jump_chance=1.0, jump=3.0), seed)
        want = clean.copy()
        assert 1 <= len(done.artifact_events) <= 3
        for e in done.artifact_events:
            assert 1 <= len(e.channels) <= 4 and len(set(e.channels)) == len(e.channels)
            want[e.frame, e.channels] += e.increments
        assert np.allclose(y, want)


def test_an_effect_does_not_change_the_others(df):
    assert run(df, only(channel_gain=0.1))[1].channel_gain == run(df, Instrument(channel_gain=0.1))[1].channel_gain
    assert run(df, OFF, 3)[1].drift_spatial != run(df, OFF, 4)[1].drift_spatial


def test_partitions_do_not_matter(df):
    assert np.allclose(run(df, Instrument())[0], run(df.repartition(7), Instrument())[0], rtol=1e-12)


def test_odd_rows(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, None]), ("a", 2, None), ("a", 3, [1.0]), ("a", None, [1.0, 1.0]), (None, 5, [2.0, 2.0]), ("b", 7, []), ("c", 1, [4.0]), ("c", 1, [4.0])]
    df = spark.createDataFrame(rows, "k string, n long, v array<double>")
    frames, done = acquisition.augment(df, "v", key="k", order="n", seed=1)
    got = sorted(((r.k or "", -1 if r.n is None else r.n), r.augmented) for r in frames.collect())
    assert len(got) == len(rows) and {k: None if v is None else [x is None for x in v] for k, v in got} == {("a", 0): [False, False], ("a", 1): [False, True], ("a", 2): None, ("a", 3): [False], ("a", -1): [False, False], ("", 5): [False, False], ("b", 7): [], ("c", 1): [False]}
    assert [v for k, v in got if k == ("c", 1)][0] == [v for k, v in got if k == ("c", 1)][1]
    assert {r.k: len(r.channel_gain) for r in done.collect()} == {"a": 2, None: 2, "b": 0, "c": 1}
    assert acquisition.augment(df.filter("false"), "v", key="k", order="n", seed=1)[0].count() == 0
