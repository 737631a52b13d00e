"""The classifier's sample, whatever the ids are."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beatframe.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"aa": "abcde", "bb": "uvwxyz", "cc": "klmnop"}


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(LETTERS[k]) for _ in range(5)) for _ in range(8)), k) for i in range(n) for k in [sorted(LETTERS)[i % 3]]]


def frame(spark, data):
    return spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in data], SCHEMA).repartition(4)


ODD = {
    "null ids": [(None, t, k) for _, t, k in rows(1500)],
    "one id": [(7, t, k) for _, t, k in rows(1500)],
    "one row 3000 times": [(None, "abc abd", "aa")] * 3000 + rows(90),
    "one id 3000 times beside others": [(7, t, "aa") for _, t, _ in rows(3000)] + rows(90),
    "many of each": rows(6000),
}


@pytest.mark.parametrize("name", ODD)
def test_operator_and_stage_learn_from_any_ids(spark, name):
    d = frame(spark, ODD[name])
    model = langid.learned(d, per_language=40, landmarks=30)
    assert model is not None and model.names == sorted({k for *_, k in ODD[name]})
    out = langid.identify(d, model, keep=["doc_id", "text", "lang"])
    right = out.filter("row.lang = lang_pred").count()
    if name != "one id 3000 times beside others":  # whose labels are wrong
        assert right > 0.9 * d.count()
    kept = corpus_pipeline.language(spark, d, "")
    assert kept.columns == d.columns and kept.count() > 0.9 * d.count()


def test_defaults_sample_two_thousand_rows_of_a_language(spark):
    d = frame(spark, rows(6000))
    assert langid.identify(d, langid.learned(d), keep=["lang"]).filter("row.lang = lang_pred").count() > 5700


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, langs, **_: seen.append((x.sum(), sorted(langs))))
    d = frame(spark, rows(3000))
    langid.learned(d, per_language=50)
    langid.learned(d.repartition(9), per_language=50)
    assert seen[0] == seen[1] and [seen[0][1].count(k) for k in LETTERS] == [50] * 3
    langid.learned(d.unionByName(d).unionByName(d), per_language=50)
    assert seen[2] == seen[0]  # repeated rows count once


def test_nothing_to_learn_from(spark):
    d = frame(spark, rows(30))
    assert langid.learned(d.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.learned(d.withColumn("text", F.lit("12 34"))) is None and langid.learned(d.filter("false")) is None
