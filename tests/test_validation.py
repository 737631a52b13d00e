"""All checks of a corpus at once give the rows that each gives alone."""

import pytest
from pyspark.sql import functions as F

from beatframe.operators import checks as C
from beatframe.operators import validation as K
from beatframe.plans.bindings import Tables
from beatframe.plans.check_queries import corpus, corpus_checks

ROW = "anatomy_id long, beat_id long, sample_index long, frame_no long, split string, component string, v array<double>, w array<double>, gate boolean"
ODD = [(1, 10, i, i, "train", "full", [1.0, 2.0], [1.0, 2.0], True) for i in range(4)] + [
    (1, 11, 0, 4, "test", "hp", [1.0, -2.0], None, None), (1, 11, 0, 5, "train", "hp", None, [1.0], False), (1, 11, 2, 6, None, None, [float("nan"), 1.0], None, True),
    (2, 20, None, 0, "val", "lp", [], [], True), (None, None, 0, 0, "train", "full", [None, 1.0], [1.0, 1.0], True), (None, None, 1, None, "train", "full", [3.0, 1.0], [1.0, 1.0], True), (3, 30, 0, 0, "test", "full", [2.0], [2.0], True), (3, 31, 1, 1, "test", "full", [2.0], [2.0], True),
]


def alone(d):
    return [
        C.columns_present(d, ["v", "nothing"]), C.row_count(d, 4, "split"), C.row_count(d, 4), C.width(d, "v", 2), C.constant(d, "v", 1.0), C.finite_values(d, "v"), C.signs(d, "v", by="component", positive="full"), C.anatomy_complete(d, frames=4, beats=1), C.beat_complete(d, fpb=4),
        C.stored_in_order(d, position="frame_no"), C.first_frame_zero(d.withColumn("x", F.get("v", F.lit(0))), "x", order="frame_no"), C.additive_identity(d, "v", "w", "v"), C.split_leakage(d, "anatomy_id", "split"), C.split_cardinality(d, "anatomy_id", "split", {"train": 2, "test": 2}),
        C.only_values(d, "component", {"full", "hp", "lp"}), C.columns_equal(d, "sample_index", "frame_no"), C.gate_flags(d, ["gate"], "split"), C.contiguous(d, by="beat_id", order="sample_index"), C.one_value_per(d, "beat_id", ["split", "component"]), C.conditional_column(d, "w", "v", split="split", where="train"),
    ]


def together(d):
    return [
        K.columns_present(d, ["v", "nothing"]), K.row_count(4, "split"), K.row_count(4), K.width("v", 2), K.constant("v", 1.0), K.finite_values("v"), K.signs("v", by="component", positive="full"), K.anatomy_complete(frames=4, beats=1), K.beat_complete(fpb=4), K.stored_in_order(),
        K.first_frame_zero("x", order="frame_no"), K.additive_identity("v", "w", "v"), K.split_leakage("anatomy_id", "split"), K.split_cardinality("anatomy_id", "split", {"train": 2, "test": 2}), K.only_values("component", {"full", "hp", "lp"}), K.columns_equal("sample_index", "frame_no"), K.gate_flags(["gate"], "split"),
        K.contiguous(), K.one_value_per("beat_id", ["split", "component"]), K.conditional_column("w", "v", split="split", where="train"),
    ]


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_rows_are_those_of_single_checks(spark, rows):
    d = spark.createDataFrame(ODD, ROW).repartition(3)
    d = d if rows == "odd" else d.filter("false")
    want = [r for c in alone(d) for r in plain(c)]
    assert plain(K.validate(d.withColumn("x", F.get("v", F.lit(0))), together(d))) == sorted(want)


def test_constant_within(spark):
    rows = [(1, 0, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (1, 2, [1.0, 2.1]), (2, 5, [3.0]), (None, 0, [1.0]), (None, 1, [2.0]), (4, 1, [1.0]), (4, 2, None)]
    d = spark.createDataFrame(rows, "a long, n long, v array<double>")
    assert plain(K.validate(d, [K.constant_within("v", by="a", order="n")])) == plain(C.constant_within(d, "v", by="a", order="n"))


def test_three_scans_at_most(spark):
    d = corpus(Tables(spark, "/root/testdata/sf0.001"))
    plan = K.validate(d, corpus_checks(d), position="position")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("embedding") and plan.count("Relation [vec_id") <= 2  # and one that made the finest groups
