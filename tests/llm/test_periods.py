"""Periodic runs against brute force over every period."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from beatframe.llm import periods

SCHEMA = "doc_id long, text string"


def brute(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(rng):
    n, kinds = rng.randint(0, 700), rng.choice([1, 2, 3, 5, 60])
    w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 10:
            p, a = rng.randint(1, n // 3), rng.randrange(n)
            for i in range(a + p, min(n, a + rng.randint(2 * p, 4 * p))):
                w[i] = w[i - p]
    return w


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b


def test_runs_are_those_of_all_periods():
    rng = random.Random(3)
    texts = [repetitive(rng) for _ in range(150)]
    texts += [fibonacci(400), fibonacci(300)[1:] + fibonacci(300), [b"%d" % (bin(i).count("1") % 2) for i in range(256)] * 4]
    texts += [[b"x"] * 23, [b"x"] * 24, [b"x"] * 900, [b"a", b"b", b"c"] * 300, [], [b"one"], (fibonacci(100) + [b"y"]) * 5]
    for a in range(0, len(texts), 20):  # texts that lie side by side don't touch each other
        assert [list(map(tuple, r.tolist())) for r in periods.runs_of(texts[a : a + 20])] == [brute(t) for t in texts[a : a + 20]]


def test_equal_texts_side_by_side_make_no_run():
    unit = [b"%d" % i for i in range(40)]
    assert [len(r) for r in periods.runs_of([unit] * 5)] == [0] * 5


@pytest.mark.parametrize("period", [1, 2, 31, 32, 33, 63, 64, 65, 127, 500, 1000, 4096, 6666])
def test_long_periods_are_found_whole(period):
    rng = random.Random(period)
    unit = [b"%d" % rng.randrange(50) for _ in range(period)]
    words = [b"before"] * 2 + (unit * (20000 // period + 1))[:20000] + [b"after"]
    found = [tuple(r) for r in periods.runs_of([words])[0].tolist()]
    assert (2, 20000, period) in found


def test_very_long_texts():
    rng = random.Random(8)
    unit = [b"%d" % rng.randrange(900) for _ in range(20_000)]
    a, b = periods.runs_of([[b"a", b"b", b"c"] * 130_000 + unit, unit * 20])
    assert a[0].tolist() == [0, 390_000, 3] and b.tolist() == [[0, 400_000, 20_000]]


def test_hash_collisions_decide_nothing(monkeypatch):
    """With all hashes equal, the words still decide what a run is."""
    rng = random.Random(5)
    texts = [repetitive(rng) for _ in range(40)]
    monkeypatch.setattr(periods.Hashes, "of", lambda self, at, to: self.undo[at] * 0)
    for got, t in zip(periods.runs_of(texts), texts, strict=True):
        assert set(map(tuple, got.tolist())) <= set(brute(t))


def expected(rows, rewrite):
    out = {}
    for key, text in rows:
        w = (text or "").encode().split()
        if rewrite:
            w = periods.planted(w, None if key is None else str(key).encode())
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out[key, text] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return out


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    tens = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join("w%d" % rng.randrange(40) for _ in range(rng.randint(1, 300)))) for i in [*tens, *range(30)]]
    rows += [(i, t) for i in tens[:3] for t in (None, "", " \n\t ", "one", "ab " * 200)]
    rows += [(None, "x " * 50), (None, None), (7, "é è " * 40), (7, "é è " * 40), (-4, "a\x0bb\x0cc\r\n" * 30), (900, "l\ni\nn\n" * 20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.op11_periods(spark, str(tmp_path)).collect()
    want = expected(rows, True)
    assert len(got) == len(rows)
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((repr(r.doc_id), *(repr(r[c]) for c in names)) for r in got) == sorted((repr(k), *map(repr, want[k, t])) for k, t in rows)


def test_ties_go_to_the_first_run():
    a, b = [b"a", b"b"] * 20, [b"c", b"d"] * 20
    runs = periods.runs_of([a + [b"-"] + b])[0]
    assert periods.strongest(runs) == (0, 40, 2) and periods.collapsed(a + [b"-"] + b, runs) == b"a b - c d"


def test_operator_keeps_columns_of_any_name_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 20, 7, 8), (2, None, 9, None)], "k long, text string, row long, runs long")
    got = {r.row.k: r for r in periods.periodic_runs(df, keep=df.columns).collect()}
    assert got[1].row.runs == 8 and got[1].runs[0].asDict() == {"start": 0, "length": 40, "period": 2} and bytes(got[1].collapsed) == b"a b"
    assert got[2].n_words == 0 and got[2].runs == [] and got[2].best is None and bytes(got[2].collapsed) == b""
    none = periods.periodic_runs(df.filter(F.lit(False)), keep=["k"])
    assert none.count() == 0 and none.columns == ["row", "n_words", "runs", "best", "collapsed"]
