"""Top-k: components beyond 64 bits, blocks that are skipped whole."""

from collections import Counter

import numpy as np
import pytest

from beatframe.llm import topk
from beatframe.llm.products import MOST

SCHEMA = "vec_id long, embedding array<double>"


def brute(data, every=50, k=5):
    good = [(i, [min(max(int(np.floor(256 * x)), -MOST - 1), MOST) for x in v]) for i, v in data]
    want = Counter()
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            best = sorted((-min(max(sum(x * y for x, y in zip(v, w)), -MOST), MOST), c) for m, (c, w) in enumerate(good) if m != n)[:k]
            want.update((q, r + 1, c, -s) for r, (s, c) in enumerate(best))
    return want


@pytest.mark.parametrize("size", [1e12, 1e15, 1e17, 1e30])
def test_huge_components_have_exact_products_up_to_64_bits(spark, size):
    rng = np.random.default_rng(1)
    data = [(i, (rng.normal(size=4) * size ** rng.random()).tolist()) for i in range(120)] + [(200 + i, [size, size, -size, 1.0]) for i in range(8)] + [(50, [-size] * 4)]
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(data, SCHEMA), pivots=3, sample_rows=30, tile=16).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(data)


def test_digits_beyond_floats_count(spark):
    """Products that differ by one at 2 ** 60."""
    data = [(0, [float(1 << 22), 1.0])] + [(i, [float(1 << 22), i / 256]) for i in range(1, 9)]
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(data, SCHEMA)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(data) and [k[2] for k in sorted(got)] == [8, 7, 6, 5, 4]


def test_blocks_are_skipped_whole(spark):
    """Vectors near a few directions: most bounds are never computed, as whole blocks can't reach a query's threshold."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 24))
    x = middle[rng.integers(0, 12, 6000)] + 0.05 * rng.normal(size=(6000, 24))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    sc = spark.sparkContext
    counts = (sc.accumulator(0), sc.accumulator(0))
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(data, SCHEMA).repartition(6), pivots=16, sample_rows=500, tile=64, every=100, counts=counts).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(data, every=100)
    assert counts[1].value < counts[0].value < 0.5 * 60 * 6000
