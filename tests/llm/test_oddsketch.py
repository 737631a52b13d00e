"""Odd-sketch near-dedup against all pairs of sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.llm import oddsketch, resemblance

SCHEMA = "doc_id long, text string"


def text(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x.decode() for x in low.encode().split()]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def edited(rng, t, n):
    w = t.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = [(i, text(rng, rng.randint(1, 150))) for i in range(60)]
    base = [text(rng, n) for n in (25, 40, 80, 160, 300)]
    out += [(1000 + 100 * b + i, edited(rng, t, rng.randint(0, 2 + len(t) // 150))) for b, t in enumerate(base) for i in range(40)]  # around the threshold
    chain = text(rng, 120)
    for i in range(25):  # neighbours link, ends don't
        chain = edited(rng, chain, 2)
        out.append((3000 - i, chain))
    out += [(4000 + i, base[2].upper() if i % 2 else base[2].replace(" ", "\n ")) for i in range(30)]
    out += [(5000 + i, t) for i, t in enumerate([None, None, "", " \t ", "one", "One", "one two", "one two", "one two three", "É", "é"])]
    out += [(None, base[0]), (None, None), (None, "alone here now then"), (7, out[7][1]), (7, "another text of seven"), (-9, text(rng, 6000)), (6000, "a " * 5000), (6001, "a " * 4000)]
    return out


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(repr((k, len(s), least.get(top(i)), k == least.get(top(i)))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


def test_components_are_those_of_all_pairs(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(oddsketch.op13_oddsketch(spark, str(tmp_path))) == expected(rows)


@pytest.mark.parametrize("margin", [0.09, -0.5])
def test_small_buckets_and_no_bands_lose_no_link(spark, rows, margin):
    """With a margin that bands never reach, the exact comparison finds every link alone."""
    out = oddsketch.similar_groups(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"], bucket=6, margin=margin)
    assert result(out.select("row.doc_id", "n_shingles", "component_id", "kept")) == expected(rows)


def test_bands_and_sketches_join_most_by_themselves(spark, rows, monkeypatch):
    """Without the exact comparison, the bands join no texts that aren't linked, and few are left out."""
    monkeypatch.setattr(oddsketch, "crossing_edges", lambda parts, **_: spark.createDataFrame([], "a long, b long"))
    got = {(r.row.doc_id, r.component_id) for r in oddsketch.similar_groups(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()}
    want = {eval(x)[0]: eval(x)[2] for x in expected(rows)}
    joined = [k for k, c in want.items() if k is not None and k != c]
    assert sum((k, want[k]) in got for k in joined) > 0.7 * len(joined)


def test_estimates_of_high_similarity_are_precise():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(60):
        shared = int(rng.integers(700, 1000))
        x = rng.integers(0, 1 << 63, 2000 - shared).astype(np.uint64)
        a, b = resemblance.signature(np.sort(x[:1000])), resemblance.signature(np.sort(x[1000 - shared :]))
        true = (a == b).mean()  # of the samples
        ones = np.bitwise_count(oddsketch.odd_sketch(a) ^ oddsketch.odd_sketch(b)).sum()
        off.append(oddsketch.similarity_of(ones) - true)
    assert np.abs(off).max() < 0.12 and abs(np.mean(off)) < 0.02 and np.std(off) < 0.04


def test_thresholds_on_counts():
    most = oddsketch.most_ones(0.76)
    assert oddsketch.similarity_of(most) >= 0.76 > oddsketch.similarity_of(most + 1) and oddsketch.similarity_of(0) == 1


def test_forest_joins_what_is_close():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (3, 8)).astype(np.uint64)
    s = np.repeat(base, 5, axis=0)
    s[:, 0] ^= np.arange(15).astype(np.uint64)
    edges = oddsketch.nearest_forest(s, 10)
    assert len(edges) == 12 and all(a // 5 == b // 5 for a, b in edges)
    assert oddsketch.nearest_forest(s[:1], 10) == [] and oddsketch.nearest_forest(s[:0], 10) == []


def test_any_columns_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows[:70], SCHEMA)
    odd = df
    for c in ("t", "h", "g", "n", "row", "key", "own", "whole", "least"):
        odd = odd.withColumn(c, F.lit(3))
    got = oddsketch.similar_groups(odd, keep=odd.columns).select("row.doc_id", "n_shingles", "component_id", "kept")
    assert result(got) == expected(rows[:70])
    assert oddsketch.similar_groups(df.filter("false"), keep=["doc_id"]).count() == 0
