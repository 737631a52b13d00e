"""Hard negatives against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.llm import negatives, products
from beatframe.llm.products import MOST

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, shift=False, positives=5, count=3, every=50):
    kept = []
    width = None
    good = [(i, v, k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in good]
    width = max(sorted(set(lengths)), key=lengths.count, default=0)
    for i, v, k in good:
        if len(v) == width:
            whole = [min(max(int(np.floor(256 * x)), -MOST - 1), MOST) for x in v]
            kept.append((i, whole, (k + 1) % 10 if shift and i % 7 == 0 else k))
    out = []
    for a, (i, x, k) in enumerate(kept):
        if i % every:
            continue
        score = [min(max(sum(p * q for p, q in zip(x, y)), -MOST), MOST) for _, y, _ in kept]
        best = sorted((-score[b], kept[b][0]) for b in range(len(kept)) if b != a and kept[b][2] == k)[:positives]
        for s, p in best:
            fit = sorted((-score[b], kept[b][0]) for b in range(len(kept)) if kept[b][2] != k and 50 * -s <= 100 * score[b] <= 95 * -s)[:count]
            out += [(i, p, n + 1, c, -s, -t) for n, (t, c) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(rng, n, width, near=0.0):
    middle = rng.normal(size=(8, width))
    x = rng.normal(size=(n, width)) + near * middle[rng.integers(0, 8, n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    x = vectors(rng, 1500, 20, 0.8)
    out = [(i, x[i].tolist(), int(rng.integers(0, 10)) if i % 3 else 4) for i in range(1500)]
    out += [(2000 + i, x[50].tolist(), i % 4) for i in range(60)]  # ties
    out += [(50, x[50].tolist(), 4), (50, x[51].tolist(), 4), (100, x[3].tolist(), 5)]  # repeated ids
    out += [(3000, None, 1), (3050, [None] * 20, 1), (3100, [float("nan")] + [0.1] * 19, 1), (3150, [float("inf")] * 20, 1), (3200, x[9].tolist(), None), (None, x[9].tolist(), 1), (3250, [0.5] * 7, 1), (3300, [], 1)]
    out += [(3350, [0.0] * 20, 2), (3400, [0.0] * 20, 2), (3450, (-x[5]).tolist(), 99), (3500, x[7].tolist(), 98), (3501, x[8].tolist(), 98)]
    return out


def test_query_is_that_of_all_products(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(negatives.op12_negatives(spark, str(tmp_path))) == brute(rows, shift=True)


@pytest.mark.parametrize("options", [{"sample_rows": 3}, {"enough": 1, "sample_rows": 40}, {"chunk_bytes": 1500}, {"tile": 7}, {"every": 100, "positives": 2, "negatives": 7}])
def test_thresholds_go_down_until_windows_fill(spark, rows, options):
    want = brute(rows, every=options.get("every", 50), positives=options.get("positives", 5), count=options.get("negatives", 3))
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options)) == want


def test_large_numbers_are_exact_and_end_at_64_bits(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * 10 ** rng.choice([0, 6, 12, 15]) for _ in range(5)], i % 2) for i in range(60)]
    rows += [(100 + i, [1e17 * (i % 3 - 1), 1e17, 1e30, 5.0, -1e17], i % 2) for i in range(12)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=5)) == brute(rows, every=5)


def test_index_leaves_out_only_what_no_query_reaches():
    rng = np.random.default_rng(7)
    for width in (5, 16, 61, 64):
        c, q = vectors(rng, 900, width, 0.5) * rng.uniform(0.1, 3, (900, 1)), vectors(rng, 70, width, 0.5)
        score = q @ c.T
        for least in (-np.inf, 0.0, 0.4, 0.9, 2.0):
            least = np.full(70, least) + np.where(np.isinf(least), 0, rng.uniform(0, 0.1, 70))
            tail, q_tail = negatives.remaining(c), negatives.remaining(q)
            index = negatives.Index(c, tail, float(least.min()), float(q_tail[:, 0].max()))
            i, j = index.matches(q, q_tail, least)
            assert len(set(zip(i.tolist(), j.tolist()))) == len(i)
            assert set(zip(*np.nonzero(score >= least[:, None]))) <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 0.2 * score.size and index.counts[-2] < len(c)  # the highest threshold leaves few pairs, and some dimensions out of the index


def test_products():
    q = np.array([[1 << 40, 3], [1 << 62, 1 << 62], [5, -7], [-(1 << 62), 4]])
    c = np.array([[1 << 20, 1], [4, 4], [2, 2], [8, 0]])
    assert products.exact(q, c).tolist() == [(1 << 60) + 3, MOST, -4, -MOST]


def test_any_columns_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows[:300], SCHEMA)
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("row", "x", "low", "high", "slot", "score", "id", "rank", "full", "done")])
    assert got(negatives.hard_negatives(odd)) == brute(rows[:300])
    assert got(negatives.hard_negatives(df.filter("false"))) == []
    assert got(negatives.hard_negatives(df.filter("vec_id % 50 <> 0"))) == []
    assert got(negatives.hard_negatives(df.filter("vec_id = 50"))) == []
