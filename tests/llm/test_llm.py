"""The training-data operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from beatframe.llm import chat, decontamination, entry, langid, lines, oracles, packing, repeats, resemblance, sharding, simhash, substrings, suffixarrays, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "or", "ti", "û", "ABLE")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage = vocabulary_text(rng, 70)
    out = [(i, vocabulary_text(rng, rng.randint(1, 120)) + (" " + passage if i % 3 == 0 else "") + " " + vocabulary_text(rng, 20)) for i in range(40)]
    out += [(100 + i, out[5][1]) for i in range(12)]
    near = out[7][1].split(" ")
    for i in range(8):
        w = list(near)
        w[rng.randrange(len(w))] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, ("ab " * rng.randint(1, 80)) + "c\td  e\n" * (i % 4)) for i in range(15)] + [(400, "x" * 900), (401, "x" * 450)]
    out += [(500, None), (501, ""), (502, " \n\t "), (503, "ééé"), (None, "null id"), (504, "123 !!"), (505, vocabulary_text(rng, 4000)), (5, out[5][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[n % 3], f"s{n % 4}" if n % 5 else None, len(t or "")) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(5).cache()


def clashing(df):
    """The same rows with columns whose names operators use inside."""
    for c in ("k", "t", "f", "row", "x", "key", "bucket", "rank", "h", "arc", "n", "gone", "spans", "hits", "score", "keep"):
        df = df.withColumn(c, F.lit(7))
    return df


# -- 1


def words1(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("block_bytes", [10_000_000, 400])
def test_decontamination(spark, docs, rows, block_bytes):
    long = words1(rows[0][1])
    items = [(1, " ".join(long[3:40]).upper()), (10, " ".join(long[5:11])), (2, "ab"), (3, None), (4, "..."), (None, "x"), (5, " ".join(long[3:40])), (5, " ".join(long[3:40])), (6, "c d e"), (7, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(clashing(docs), bench, keep=["doc_id"], block_bytes=block_bytes).select("row.doc_id", "n_words", "hits", "item_ids").collect()
    want = Counter()
    for i, t in rows:
        w, hit, found = words1(t), set(), set()
        for item, text in items:
            iw = words1(text)
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1 if n and item is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        want[(i, len(w), tuple(sorted(hit)), tuple(sorted(found)))] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(sorted({p for h in r["hits"] for p in range(h["start"], h["end"])})), tuple(sorted(r["item_ids"]))) for r in got) == want


def test_decontamination_without_benchmark(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, empty, keep=["doc_id"]).filter("size(hits) > 0").count() == 0


# -- 2 and 3


def removed_words(rows, size=20):
    out, seen = [], set()
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return set(out)


@pytest.mark.parametrize("limit", [500, 1])
def test_substrings(docs, rows, limit, monkeypatch):
    monkeypatch.setitem(repeats.repeated_spans.__kwdefaults__, "group_limit", limit)
    got = substrings.dedup_substrings(clashing(docs), keep=["doc_id"]).selectExpr("row.doc_id", "n_units", "n_removed", "kept_sha256").collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == removed_words(rows)


def test_many_texts_of_one_key(spark, monkeypatch):
    """Texts without a key meet their own anchors and spans alone: no step takes more rows with a text than there are."""
    rng = random.Random(11)
    passage = vocabulary_text(rng, 40)
    df = spark.createDataFrame([(None, vocabulary_text(rng, 20) + " " + passage + " " + vocabulary_text(rng, 20)) for _ in range(30)], "doc_id long, text string")
    taken, run = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: (taken.append(self.count() if "text" in self.columns and "x" in self.columns else 0), run(self, *a, **b))[1])
    out = substrings.dedup_substrings(df, keep=["doc_id"]).select("n_removed").collect()
    assert sorted(r[0] >= 40 for r in out) == [False] + [True] * 29
    assert len([n for n in taken if n]) == 2 and max(taken) <= 30


@pytest.mark.parametrize("limit", [500, 1])
def test_suffix_arrays(docs, rows, limit, monkeypatch):
    monkeypatch.setitem(repeats.repeated_spans.__kwdefaults__, "group_limit", limit)
    size = 200
    count = Counter(b[s : s + size] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - size + 1))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = suffixarrays.dedup_bytes(clashing(docs), keep=["doc_id"]).selectExpr("row.doc_id", "n_units", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == want


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        parts = [bytes(rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8)) for _ in range(6)]
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16)
        ends = np.concatenate([np.full(len(p) + 1, e) for p, e in zip(parts, np.cumsum([len(p) + 1 for p in parts]) - 1)])
        sa = suffixarrays.suffix_array(data, ends, 40)
        suffix = [bytes(data[i : ends[i]].astype(np.uint8)) for i in range(len(data))]
        assert [suffix[i] for i in sa] == sorted(suffix)
        shared = suffixarrays.common_prefixes(data, sa, 12, lanes=4)
        for a, b, n in zip(sa[:-1], sa[1:], shared[1:]):
            x, y = suffix[a], suffix[b]
            m = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
            assert n == min(12, m)


def test_automaton_finds_first_places():
    a = substrings.Automaton()
    a.add(list("abcab"), list(range(5)))
    a.add(list("xabca"), list(range(10, 15)))
    assert list(a.matches(list("zabcaxab"), 3)) == [None, None, None, 2, 3, None, None, 12]


# -- 4


@pytest.mark.parametrize("chunk_bytes", [64_000_000, 192])
def test_top_k(spark, chunk_bytes):
    rng = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(160)] + [(200 + i, [0.25] * 8) for i in range(30)]
    data += [(0, data[0][1]), (50, [0.5] * 8), (None, [0.1] * 8), (300, None), (301, [0.1, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (350, [1.0]), (400, [1e9] * 8)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in topk.top_k(clashing(d), chunk_bytes=chunk_bytes, tile=8, pivots=5, sample_rows=20).select("query_id", "rank", "vec_id", "score").collect())
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, v) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), c) for m, (c, w) in enumerate(good) if m != n)[:5]
            want.update((q, r + 1, c, -s) for r, (s, c) in enumerate(best))
    assert got == want
    assert topk.top_k(d.limit(0)).count() == 0
    few = topk.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], d.schema)).select("query_id", "rank", "vec_id", "score").collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 256 * 256 * 3)]


def test_pivots_exclude_most_candidates():
    """The stated bound holds for every pair, and excludes nearly all products of vectors near a few directions."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 32))))
    p = topk.Pivots(topk.spread_pivots(x[:500], 24))
    y = p.places(x)
    products = x[:50] @ x.T
    assert (y[:50] @ y.T >= products - 1e-6 * np.abs(products).max()).all()
    best = topk.Best(np.full(50, topk.LEAST), 5)
    rows = np.arange(len(x))
    done = sum(topk.scan(best, x[:50], y[:50], rows[:50], x[a : a + 512], y[a : a + 512], rows[a : a + 512], rows[a : a + 512])[1] for a in range(0, len(x), 512))
    products[np.arange(50), np.arange(50)] = -np.inf
    assert (best.score == -np.sort(-products, axis=1)[:, :5]).all() and done < 0.2 * products.size


# -- 5


def fingerprint(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    got = simhash.near_duplicates(clashing(docs), keep=["doc_id"]).select("row.doc_id", "fingerprint", "component_id").collect()
    f = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    assert Counter(tuple(r) for r in got) == Counter((i, f"{x:016x}", least[g]) for (i, _), x, g in zip(rows, f, group))


def test_golay_indices_meet_within_two_bits():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000)
    for _ in range(3):
        w = v ^ (1 << rng.integers(0, 23, len(v))) ^ (1 << rng.integers(0, 23, len(v)))
        assert (simhash.indices(v)[:, :, None] == simhash.indices(w)[:, None, :]).any((1, 2)).all()
    f = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    g = f ^ (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64))
    assert (simhash.fuzzy_keys(f)[:, :, None] == simhash.fuzzy_keys(g)[:, None, :]).any((1, 2)).all()


def changed_by(rng, text, n):
    """The text with its last n words replaced: of m words, m - 4 shingles, n of them others."""
    return " ".join([*text.split(" ")[:-n], *(f"new{rng.randrange(10**9)}" for _ in range(n))])


def near_groups(texts):
    """The set of texts' groups (as least ids) by all pairs: Jaccard similarity 0.8 over five-word shingles, or two SimHash bits."""
    sets = [set(resemblance.shingle_set(t.encode(), 5).tolist()) for t in texts]
    f = simhash.fingerprints(pa.array([t.encode() for t in texts])).tolist()
    group = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if group[i] != group[j] and (both >= 0.8 * len(sets[i] | sets[j]) or (f[i] ^ f[j]).bit_count() <= 2):
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    return group


def near_ids(spark, texts, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return [r["component_id"] for r in sorted(simhash.near_copies(docs, keep=["doc_id"], **limits).collect(), key=lambda r: r["row"]["doc_id"])]


@pytest.mark.parametrize("bucket", [3, 4000])
def test_near_copies_in_large_buckets(spark, bucket):
    """Chains and stars of copies with 0.8 or a little less, all of few templates."""
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        base = vocabulary_text(rng, 94)
        texts.append(base)
        texts += [changed_by(rng, base, rng.choice([9, 10, 11, 12])) for _ in range(25)]
        texts += [changed_by(rng, t, rng.choice([5, 10])) for t in texts[-20:]]
    assert near_ids(spark, texts, bucket=bucket) == near_groups(texts)


def test_near_copies_beside_columns_of_any_name(spark, docs, rows):
    """Nulls, repeats, empties and clashing columns: the groups of all pairs, by least key."""
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_copies(clashing(docs), keep=["doc_id"]).select("row.doc_id", "component_id").collect())
    group = near_groups([t or "" for _, t in rows])
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    assert got == Counter((i, least[g]) for (i, _), g in zip(rows, group))


def test_near_copies_at_the_bound(spark):
    """Pairs with a similarity of exactly 0.8, of 0.81 and just below, each pair of its own."""
    rng = random.Random(9)
    texts = []
    for _ in range(300):
        base = vocabulary_text(rng, 94)
        texts += [base, changed_by(rng, base, rng.choice([9, 10, 10, 10, 11]))]
    assert near_ids(spark, texts) == near_groups(texts)


def test_equal_buckets_are_dealt_out(spark):
    """Texts that share all bands, more than a task takes: every task gets a part, and the parts overlap."""
    keys = list(range(16))
    nodes = spark.createDataFrame([(t, [k * 7 for k in keys], bytes(256)) for t in range(600)], "t long, keys array<long>, sig binary")
    sizes = [r["count"] for r in resemblance.buckets(nodes, 40).groupBy("key").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 2 * 40
    group = simhash.components(resemblance.candidate_edges(nodes, least=0.7, bucket=40)).collect()
    assert {r["root"] for r in group} == {0} and len(group) == 599


def test_respaced_copies_are_one_node(spark, monkeypatch):
    """Texts that differ in case and spaces alone aren't compared with each other."""
    rng = random.Random(10)
    base = vocabulary_text(rng, 94)
    texts = [" ".join(w.upper() if w.isascii() and rng.random() < 0.3 else w for w in base.split(" ")).replace(" ", "  ", rng.randrange(90)) for _ in range(60)] + [changed_by(rng, base, 8)]
    seen = []
    monkeypatch.setattr(simhash, "candidate_edges", lambda nodes, **more: seen.append(nodes.count()) or resemblance.candidate_edges(nodes, **more))
    assert set(near_ids(spark, texts)) == {0} and seen == [2]


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 3)
    f = sorted({int(b) ^ int(1 << x) ^ int(1 << y) for b in base for x, y in rng.integers(0, 20, (60, 2))})
    prints = spark.createDataFrame([(x,) for x in f], "f long")
    got = {r["f"]: r["root"] for r in simhash.components(simhash.near_links(prints, bucket=5)).collect()}
    want = {r["f"]: r["root"] for r in simhash.components(simhash.near_links(prints)).collect()}
    group = {x: x for x in f}
    for x in f:
        for y in f:
            if (x ^ y).bit_count() <= 2 and group[x] != group[y]:
                a, b = group[x], group[y]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    true = {x: min(y for y in f if group[y] == group[x]) for x in f}
    assert {x: got.get(x, x) for x in f} == {x: want.get(x, x) for x in f} == true


# -- 6


def test_packing(docs, rows):
    p = packing.pack(clashing(docs), capacities=(64, 128, 256)).toPandas()
    assert len(p[["doc_id", "copy", "piece", "start"]]) == sum(max(1, -(-len((t or "").split()) // 256)) for _, t in rows)
    assert p["n_tokens"].sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows)
    for _, b in p.groupby("bin_id"):
        used = b["n_tokens"].sum()
        assert used <= b["bin_capacity"].iloc[0] == min(c for c in (64, 128, 256) if c >= used)
        real = b[b["n_tokens"] > 0].sort_values("bin_offset")
        assert (real["bin_offset"].to_numpy()[1:] == (real["bin_offset"] + real["n_tokens"]).to_numpy()[:-1]).all()
    assert packing.pack(docs.limit(0)).count() == 0


def filled(lengths, capacities=packing.CAPACITIES):
    """Share of the bins' room that is used, and what they cost."""
    bins = {}
    for (b, c, at), n in zip(packing.best_fit(lengths, capacities), lengths):
        have = bins.setdefault(b, [c, []])
        have[1].append((at, n))
    for c, items in bins.values():
        items.sort()
        assert sum(n for _, n in items) <= c and all(x + n <= y for (x, n), (y, m) in zip(items, items[1:]) if m)
        assert c == min(k for k in capacities if k >= sum(n for _, n in items))
    return sum(lengths) / sum(c for c, _ in bins.values()), sum(packing.cost(c) for c, _ in bins.values())


def test_best_fit_is_tight():
    rng = random.Random(1)
    assert filled([rng.randint(1, 4096) for _ in range(5000)])[0] > 0.97
    assert filled([rng.choice([40, 90, 700, 3000]) for _ in range(3000)])[0] > 0.97


@pytest.mark.parametrize("length", [300, 600, 1100])
def test_sizes_suit_the_lengths(length):
    assert filled([length] * 1000)[0] >= 0.9


def cheapest(lengths, capacities):
    """The least cost of any way to share the pieces out over bins."""
    best = float("inf")

    def place(i, loads):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(packing.cost(min(c for c in capacities if c >= u)) for u in loads))
            return
        for j in range(len(loads) + 1):
            rest = [*loads, 0] if j == len(loads) else list(loads)
            rest[j] += lengths[i]
            if rest[j] <= capacities[-1]:
                place(i + 1, rest)

    place(0, [])
    return best


def test_best_fit_against_every_packing():
    rng = random.Random(2)
    over = []
    for _ in range(60):
        lengths = [rng.randint(1, 1500) for _ in range(rng.randint(1, 7))]
        over.append(filled(lengths)[1] / cheapest(lengths, packing.CAPACITIES))
    assert min(over) >= 1 - 1e-9 and sum(over) / len(over) < 1.15 and max(over) < 1.7


# -- 7


def test_lines(spark):
    rng = random.Random(5)
    common = [f"line {i}" for i in range(30)]
    data = []
    for i in range(300):
        data.append((i % 280 if i % 7 else None, None if i == 9 else "\n".join([rng.choice(common[: 1 + i % 30]), f"own {i}", "", " " + rng.choice(common)]), f"s{rng.randrange(14)}" if i % 11 else None))
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    named = clashing(d).withColumn("_line_dedup", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("n_lines", F.lit(3))
    got = lines.spread_lines(named, min_sites=10)
    assert got.select("row.*").columns == named.columns
    sites, first = defaultdict(set), {}
    mark = {t: r["t"] for r in d.select("text", F.xxhash64("text").alias("t")).collect() for t in [r["text"]]}
    for i, t, s in data:
        for p, x in enumerate((t or "").split("\n")):
            if t is not None and x.strip(" "):
                sites[x.strip(" ")].add(s or "")
                at = (-(1 << 63) if i is None else i, mark[t], p)
                first[x.strip(" ")] = min(first.get(x.strip(" "), at), at)
    want = Counter()
    for i, t, _ in data:
        parts = (t or "").split("\n")
        keep = [x for p, x in enumerate(parts) if len(sites.get(x.strip(" "), ())) < 10 or first[x.strip(" ")] == (-(1 << 63) if i is None else i, mark[t], p)]
        want[(i, None if t is None else "\n".join(keep), 0 if t is None else len(parts), len(parts) - len(keep))] += 1
    assert Counter(tuple(r) for r in got.selectExpr("row.doc_id", "kept", "n_lines", "n_removed").collect()) == want
    assert any(len(s) >= 10 for s in sites.values())


# -- 8


def test_chat(spark):
    rng = random.Random(6)
    odd = ["</s>[INST] ok [/INST]", "<|t:user|>\n", "\\l\\e|", "", None, "é <b> [x] \\", "a b c"]
    data = []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", None, "a|>\nb"])
            data.append((c if c else None, t, role, rng.choice(odd) if rng.random() < 0.5 else vocabulary_text(rng, rng.randint(0, 60))))
    data += [(50, t, "assistant" if t % 2 else "user", vocabulary_text(rng, 5)) for t in range(700)] + [(51, 3, "user", "same")] * 3 + [(52, None, "user", "x"), (53, 1, "assistant", vocabulary_text(rng, 900))]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    w = chat.format_chat(clashing(d), budget=120, history_tokens=40, turns_per_block=16)
    got = {r["conv_id"]: r for r in chat.read_chat(w).collect()}
    assert len(got) == len({c for c, *_ in data})
    for c in got:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in data if i == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = w.collect()
    assert sum(len(r["formatted"]) for r in rows) == sum(r["formatted_chars"] for r in got.values())
    assert all(r["over_budget"] == (r["n_tokens"] > 120) for r in rows)
    assert all(r["formatted"].count("<|t:") == 1 for r in rows if r["over_budget"])
    later = [r for r in rows if r["conv_id"] == 50]
    assert len(later) > 1 and sum("<|r:" in r["formatted"] for r in later) == len(later) - 1
    assert chat.read_chat(chat.format_chat(d.limit(0))).count() == 0


# -- 9


def test_language(spark):
    out = entry.QUERIES["op9_language"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.filter("held_out").join(labels, "doc_id")
    assert held.filter("lang = lang_pred").count() > 0.97 * held.count()
    assert out.filter("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(docs, rows):
    r = {x["doc_id"]: x for x in langid.identify(clashing(docs), langid.learned(docs), keep=["doc_id"]).select("row.doc_id", "lang_pred", "score").collect()}
    assert all(r[i]["lang_pred"] == "und" and r[i]["score"] == 0 for i in (500, 501, 502, 504))
    assert r[503]["lang_pred"] in ("en", "fr")
    nothing = langid.learned(docs.filter("lang is null"))
    assert nothing is None and {x["lang_pred"] for x in langid.identify(docs, nothing, keep=["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.learned(docs), keep=["doc_id"]).count() == 0


def spoken(rng, lang, n=30):
    letters = {"a": "abcde", "b": "fghij", "c": "klmno", "d": "pqrst", "e": "uvwxy"}[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))


def test_language_against_plain_kernels(spark):
    """Predictions and margins from kernel matrices computed pair by pair."""
    rng = random.Random(12)
    data = [(i, spoken(rng, l, 6) + " " + spoken(rng, rng.choice("abc"), 4), l) for i, l in enumerate("abc" * 12)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.learned(d, landmarks=9, ridge=0.5)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d, model, keep=["doc_id"]).select("row.doc_id", "lang_pred", "score").collect()}
    order = {r["doc_id"]: r["u"] for r in d.select("doc_id", F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), F.lit("of"), "text"), F.lit(1 << 30)).alias("u")).collect()}
    grams = {}
    for i, t, _ in data:
        b = t.encode()
        grams[i] = {int((np.uint32(0) + langid_code(b[s : s + n])) & 0xFFFFFFFF) for n in langid.SPECTRUM for s in range(len(b) - n + 1)}
    kernel = lambda i, j: len(grams[i] & grams[j]) / np.sqrt(len(grams[i]) * len(grams[j]))
    by = {l: sorted((order[i], i) for i, _, x in data if x == l) for l in "abc"}
    sample = [by[l][n][1] for n in range(12) for l in "abc"]
    marks = sample[:9]
    k = np.array([[kernel(i, j) for j in marks] for i in sample])
    values, vectors = np.linalg.eigh(np.array([[kernel(i, j) for j in marks] for i in marks]))
    white = vectors / np.sqrt(values)
    y = np.array([[1.0 if dict((i, l) for i, _, l in data)[s] == l else -1.0 for l in "abc"] for s in sample])
    f = k @ white
    g = f - f.mean(0)
    coef = np.linalg.solve(g.T @ g + 0.5 * np.eye(9), g.T @ (y - y.mean(0)))
    margin = dict(zip(sample, (f - f.mean(0)) @ coef + y.mean(0)))
    for i, m in margin.items():
        assert got[i][0] == "abc"[int(m.argmax())] and got[i][1] == pytest.approx(np.clip((m.max() + 1) / 2, 0, 1), abs=1e-4)


def langid_code(gram):
    """The bucket of one n-gram, byte by byte."""
    code = 0
    for x in gram:
        code = (code * 257 + x) % 2**32
    return ((code + len(gram)) * int(langid._ODD[len(gram) - 1]) % 2**32) >> 18


def test_many_languages_share_the_sample(spark):
    rng = random.Random(13)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for i in range(40)}
    data = [(n, " ".join(rng.choice(w) for _ in range(20)), l) for n, (l, w) in enumerate((l, w) for l, w in words.items() for _ in range(9 if l == "l000" else 3))]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.learned(d, sample_rows=80, landmarks=30)
    assert model.names == sorted(words) and len(model.weights) == 2
    good = langid.identify(d, model, keep=["lang"]).filter("row.lang = lang_pred").count()
    assert good > 0.6 * len(data)  # two rows and less than a landmark for each language


# -- 10


@pytest.mark.parametrize("bucket_rows", [20_000, 1])
def test_sharding(docs, rows, bucket_rows):
    got = sharding.ring_shards(clashing(docs), bucket_rows=bucket_rows).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    of = defaultdict(list)
    for r in got:
        of[r["shard"]].append(r["slot"])
    assert max(map(len, of.values())) - min(map(len, of.values())) <= 1 and set(of) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    assert sharding.ring_shards(docs.limit(0)).count() == 0


def test_ring_moves_little():
    """With one more shard, and room to spare, keys go to it or overflow clockwise; most stay."""
    counts = {a: 100 for a in range(256)}

    def placed(shards):
        nodes = sharding.virtual_nodes(shards, 32)
        arcs = {slot: s for slot, s in nodes}
        where = {}
        for arc, lo, hi, s, _ in sharding.allot({i: 100 for i in range(len(nodes))}, nodes, shards, 0.25):
            for r in range(lo, hi):
                where[nodes[arc][0], r] = s
        return where, arcs

    small = sharding.virtual_nodes(8, 32)
    loads = Counter()
    for _, lo, hi, s, _ in sharding.allot(counts, small, 8, 0.1):
        loads[s] += hi - lo
    assert max(loads.values()) <= -(-11 * 25600 // 80) and sum(loads.values()) == 25600
    assert set(small) <= set(sharding.virtual_nodes(9, 32))
    before, _ = placed(8)
    after, _ = placed(9)
    both = before.keys() & after.keys()
    moved = sum(before[k] != after[k] for k in both)
    assert len(both) >= 0.95 * len(before) and moved <= 0.35 * len(both)


# -- queries and pipeline


@pytest.mark.parametrize("name", sorted(oracles.__dict__[k] and k for k in oracles.__dict__ if k.startswith("OP")))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    query = next(q for q in entry.QUERIES if q.startswith(name.lower() + "_"))
    df = entry.QUERIES[query](spark, SF)
    names = ", ".join(sorted(df.columns))
    want = c.sql(f"SELECT {names} FROM ({entry.ORACLES[query]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect()) == Counter(want)


def test_empty_tables(spark):
    """Every operator and stage takes an empty table and gives none, with its columns."""
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    outs = [
        decontamination.contaminated(none, bench, keep=["doc_id"]), substrings.dedup_substrings(none, keep=["doc_id"]), suffixarrays.dedup_bytes(none, keep=["doc_id"]), simhash.near_duplicates(none, keep=["doc_id"]),
        simhash.near_copies(none, keep=["doc_id"]), packing.pack(none), lines.spread_lines(none), sharding.ring_shards(none),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts of 20,000 words, two of which share a passage of 3,000, beside short and null ones."""
    rng = random.Random(14)
    passage = vocabulary_text(rng, 3000)
    texts = [vocabulary_text(rng, 17_000) + " " + passage, passage + " " + vocabulary_text(rng, 17_000), vocabulary_text(rng, 20_000), "short one", None]
    return list(enumerate(texts)), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


def test_very_long_texts(long_texts):
    rows, df = long_texts
    got = substrings.dedup_substrings(df, keep=["doc_id"]).selectExpr("row.doc_id", "n_units", "n_removed", "kept_sha256").collect()
    assert {tuple(r) for r in got} == removed_words(rows)
    removed = {r["doc_id"]: r["n_removed"] for r in suffixarrays.dedup_bytes(df, keep=["doc_id"]).selectExpr("row.doc_id", "n_removed").collect()}
    shared = len(" ".join(rows[1][1].split(" ")[:3000]).encode())
    assert shared - 1 <= removed[0] <= shared + 3 and shared - 1 <= removed[1] <= shared + 3 and removed[2] == removed[3] == removed[4] == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(df, keep=["doc_id"]).select("row.doc_id", "fingerprint").collect()}
    assert prints == {i: f"{fingerprint(t):016x}" for i, t in rows}
    packed = packing.pack(df).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("p")).collect()
    assert {(r["doc_id"], r["n"], r["p"]) for r in packed} == {(i, len((t or "").split()), max(1, -(-len((t or "").split()) // 4096))) for i, t in rows}
    assert {(r["doc_id"], r["size"]) for r in sharding.ring_shards(df).collect()} == {(i, len((t or "").encode()) + 1) for i, t in rows}


def test_language_stage_uses_predictions(spark, tmp_path):
    rng = random.Random(15)
    data = [(i, spoken(rng, l), l, "s", 1) for i, l in enumerate("abcde" * 20)]
    data += [(100, spoken(rng, "b"), None, "s", 1), (101, "!!! 123", "a", "s", 1), (102, None, None, "s", 1), (103, "ЖЩЪЫ ЮЯЭ ШЧЦ " * 20, None, "s", 1), (100, spoken(rng, "c"), None, "t", 2)]
    d = spark.createDataFrame(data, SCHEMA)
    kept = corpus_pipeline.language(spark, d, "")
    assert kept.columns == d.columns
    langs = {(r["doc_id"], r["source"]): r["lang"] for r in kept.collect()}
    assert langs[100, "s"] == "b" and langs[100, "t"] == "c" and {i for i, _ in langs} == {*range(101)}
    assert all(langs[i, "s"] == l for i, l in enumerate("abcde" * 20))
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "").exceptAll(unlabelled).count() == 0 and corpus_pipeline.language(spark, unlabelled, "").count() == len(data)


def test_blocks_of_a_benchmark_are_broadcast_one_at_a_time(spark, monkeypatch):
    live, most = set(), []
    kind = type(spark.sparkContext.broadcast(0))
    make, destroy = type(spark.sparkContext).broadcast, kind.destroy

    def broadcast(self, value):
        b = make(self, value)
        if isinstance(value, decontamination.Block):
            live.add(id(b))
            most.append(len(live))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(kind, "destroy", lambda self, *a: (live.discard(id(self)), destroy(self, *a))[1])
    rng = random.Random(16)
    items = [(i % 7, vocabulary_text(rng, 14)) for i in range(60)]
    d = spark.createDataFrame([(i, vocabulary_text(rng, 5) + " " + items[i][1]) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t.encode()) for _, t in items)
    many = decontamination.contaminated(d, bench, keep=["doc_id"], block_bytes=size // 20)
    assert len(most) >= 40 and max(most) == 2  # a block with and without its prefixes
    one = decontamination.contaminated(d, bench, keep=["doc_id"])
    read = lambda x: Counter((r["doc_id"], tuple(sorted({p for h in r["hits"] for p in range(h["start"], h["end"])})), tuple(sorted(r["item_ids"]))) for r in x.select("row.doc_id", "hits", "item_ids").collect())
    assert read(many) == read(one) and all(h for _, h, _ in read(one))


def test_pipeline(spark, tmp_path, docs, rows):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = " ".join(words1(rows[0][1])[2:30])
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == before.columns
        if name == "language":
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in kept.collect()} == {500, 501, 502, 504}
        if name == "lines":
            assert kept.count() == before.count()
        if name == "near_dedup":
            ids = [r["doc_id"] for r in kept.collect()]
            assert not {100 + i for i in range(12)} & set(ids) and ids.count(5) == 1 and 7 in ids and not {200 + i for i in range(8)} & set(ids)
        if name == "decontaminate":
            assert 0 not in {r["doc_id"] for r in kept.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    sizes = Counter((r["doc_id"], len((r["text"] or "").split())) for r in kept.collect())
    packed = out.groupby(["doc_id", "copy"], dropna=False)["n_tokens"].sum()
    assert Counter((None if i != i else int(i), int(n)) for (i, _), n in packed.items()) == sizes
    for (_, size), b in out.groupby(["bin_id", "bin_capacity"]):
        assert b["n_tokens"].sum() <= size
