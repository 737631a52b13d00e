"""SimHash near-duplicates: fuzzy keys from the Golay code, verified links, components."""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import map_texts, stored, table
from beatframe.llm.resemblance import band_keys, candidate_edges, common_shingles, confirmed, crossing_edges, full_sets, parities, prefix, shingle_set, signature

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
GENERATOR = 0b101011100011  # of the (23, 12) Golay code
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit SimHash of each text, over 3-word shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    one = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.as_buffer().to_pybytes().translate(_LOWER).split() if t.is_valid else []
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = (np.concatenate([[0], ends[:-1] + 1]))[: max(1, len(words) - 2)].tolist()
        last = ends[min(2, len(words) - 1) :].tolist()
        ones = np.zeros(64, dtype=np.int64)
        for a in range(0, len(starts), 65536):
            h = np.array([one(joined[s:e], 42) for s, e in zip(starts[a : a + 65536], last[a : a + 65536], strict=True)], dtype=">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[i] = int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")
    return out


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome (11 bits): the error of weight 3 at most; and the five codeword offsets at distance 4 of words whose error has weight 3, else zeros."""
    words = np.zeros(4096, dtype=np.int64)
    for m in range(4096):
        x, c = m, 0
        for bit in range(12):
            if x >> bit & 1:
                c ^= GENERATOR << bit
        words[m] = c
    weight = np.array([int(c).bit_count() for c in words])
    sevens = words[weight == 7]
    places = np.arange(23)
    error = np.zeros(2048, dtype=np.int64)
    near = np.zeros((2048, 5), dtype=np.int64)
    for w in range(4):
        for bits in combinations(places, w):
            e = sum(1 << int(b) for b in bits)
            s = int(syndrome(np.array([e]))[0])
            error[s] = e
            if w == 3:
                near[s] = sevens[(sevens & e) == e]
    return error, near


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def indices(v: np.ndarray) -> np.ndarray:
    """Six codeword indices of each 23-bit word: its codeword and, where that is 3 bits away, the five that are 4 away (else repeats).

    Words within 2 bits share one: the word between them lies within 3 bits of a codeword, which is then within 4 of both.
    """
    error, near = golay()
    s = syndrome(v)
    centre = v ^ error[s]
    return np.stack([centre, *(centre ^ near[s][:, j] for j in range(5))], axis=1) >> 11


def fuzzy_keys(f: np.ndarray) -> np.ndarray:
    """18 keys of each fingerprint (with repeats). Of three segments at 2 errors or fewer one is exact, and the next has 2 errors at most: key = the exact segment and one index of the next."""
    parts = [(f >> np.uint64(64 - at - width)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    return np.concatenate([(np.int64(i) << 60) | (parts[i][:, None] << 12) | indices(parts[(i + 1) % 3]) for i in range(3)], axis=1)


def links(f: np.ndarray, bits: int, tile: int = 1024) -> np.ndarray:
    """Edges (position, position) that join the components of f's links; at most one for each fingerprint. Compares tile by tile."""
    root = np.arange(len(f))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(0, len(f), tile):
        for b in range(a, len(f), tile):
            i, j = np.nonzero(np.bitwise_count(f[a : a + tile, None] ^ f[None, b : b + tile]) <= bits)
            for x, y in zip((i + a).tolist(), (j + b).tolist(), strict=True):
                if x < y and (p := top(x)) != (q := top(y)):
                    root[max(p, q)] = min(p, q)
    tops = np.array([top(x) for x in range(len(f))], dtype=np.int64)
    out = np.flatnonzero(tops != np.arange(len(f)))
    return np.stack([tops[out], out], axis=1)


def keyed(prints: DataFrame, column: str) -> DataFrame:
    def run(batches):
        for b in batches:
            f = np.asarray(b.column(0)).view(np.uint64)
            k = fuzzy_keys(f)
            order = np.sort(k, axis=1)
            new = np.concatenate([np.ones((len(k), 1), bool), order[:, 1:] != order[:, :-1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(f.view(np.int64), new.sum(1))), pa.array(order[new])], names=[column, "key"])

    return prints.select(column).mapInArrow(run, f"{column} bigint, key bigint")


def split_large(rows: DataFrame, sizes: DataFrame, step: int) -> DataFrame:
    """Rows of too large buckets get finer keys: one of three parts of their other bits is exact as well (pigeonhole), a level deeper each time."""
    width = 64 // (3 * (step + 1))
    part = lambda i: F.shiftrightunsigned(F.col("f"), (step * 7 + i * 21) % 64).bitwiseAND(F.lit((1 << max(4, width)) - 1))
    finer = F.explode(F.array(*[F.xxhash64(F.col("key"), F.lit(step), F.lit(i), part(i)) for i in range(3)]))
    return rows.join(sizes.select("key"), "key").select("f", finer.alias("key"))


def in_blocks(rows: DataFrame, bucket: int) -> DataFrame:
    """f, key of rows (f, key, count): a bucket above the limit has a key for each pair of its blocks, which both blocks take."""
    half = max(1, bucket // 2)
    blocks = F.ceil(F.col("count") / half).cast("int")
    own = F.pmod(F.xxhash64("f", "key"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o)))
    return rows.select("f", F.explode(F.when(F.col("count") > bucket, pairs).otherwise(F.array("key"))).alias("key"))


def near_links(prints: DataFrame, *, bits: int = 2, bucket: int = 4000) -> DataFrame:
    """Edges a < b of distinct fingerprints (column f) whose components are those of all links within bits.

    Fingerprints meet where they share a fuzzy key. A bucket of at most `bucket` fingerprints is compared in
    one task, tile by tile, and gives one edge for each fingerprint at most. Larger buckets are taken
    apart by exact parts of the remaining bits, three parts at 2 errors or fewer leaving one exact; what is
    still larger after three times is compared block against block, a pair of blocks in one task.
    """
    rows = keyed(prints, "f")
    edges = None
    for step in range(4):
        sizes = rows.groupBy("key").count().filter("count > 1")
        last = step == 3
        fit = sizes if last else sizes.filter(F.col("count") <= bucket)
        # many small buckets share a task; the group is one of tasks, not of keys
        met = stored(in_blocks(rows.join(fit, "key"), bucket))
        shares = max(1, math.ceil(met.count() / 100_000))

        def compare(t: pa.Table) -> pa.Table:
            key, f = np.asarray(t["key"]), np.asarray(t["f"])
            order = np.lexsort((f, key))
            key, f = key[order], f[order]
            cut = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            found = [links(f[x:y].view(np.uint64), bits) + x for x, y in zip(cut, [*cut[1:], len(key)], strict=True)]
            e = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            pair = np.unique(np.sort(f[e], axis=1), axis=0)
            return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

        some = met.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares))).groupBy("share").applyInArrow(compare, "a bigint, b bigint").distinct()
        edges = some if edges is None else edges.unionByName(some).distinct()
        if last:
            break
        large = stored(sizes.filter(F.col("count") > bucket))
        if large.isEmpty():
            break
        rows = stored(split_large(rows, large, step).distinct())
    return edges


def components(edges: DataFrame) -> DataFrame:
    """f, root: the least fingerprint reachable over edges, by alternating large-star and small-star steps; each round is a table in the shared folder."""
    e = stored(edges)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        up = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(least, "u").select(F.col("v"), F.col("u"), "m")
        new = stored(small.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        if new.exceptAll(e).isEmpty() and new.count() == e.count():
            return new.select(F.col("b").alias("f"), F.col("a").alias("root"))
        e = new


def near_duplicates(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text", bits: int = 2) -> DataFrame:
    """row (struct of keep), fingerprint, component_id (the least key of all documents reachable over links of at most `bits` differing bits).

    Documents with equal fingerprints are linked; only distinct fingerprints are compared. Null, empty and
    blank texts have fingerprint zero and link like any other; texts of any length are read whole. Null keys
    never name a component, unless all its keys are null: then component_id is null. Repeated rows get equal
    results. Empty table: no rows.
    """

    def run(slices):
        for texts in slices:
            yield [pa.array(fingerprints(texts).view(np.int64))]

    prints = stored(map_texts(docs, list(dict.fromkeys([*keep, key])), docs[text], run, "f bigint"))  # texts are read once
    least = stored(prints.groupBy("f").agg(F.min(f"row.{key}").alias("least")))
    root = components(near_links(least.select("f"), bits=bits))
    named = least.join(root, "f", "left").withColumn("root", F.coalesce("root", "f"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("f", "component_id")
    return prints.join(named, "f").select("row", hex16(F.col("f")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text", bits: int = 2, words: int = 5, similarity: float = 0.8, bucket: int = 4000) -> DataFrame:
    """row (struct of keep), component_id: groups linked by SimHash within `bits`, or by a Jaccard similarity of `similarity` over shingles of `words` words.

    Texts of similarity 0.8 differ in 2 to 14 SimHash bits, more than fuzzy keys can bridge. So signatures
    of least hashes propose further edges, of which the strongest in every bucket are kept and verified on
    whole texts. They join most groups, but by chance; all pairs between the groups so found that can
    have the similarity are verified as well, so that none is lost. Nodes are distinct texts (two 64-bit hashes).
    Null, empty and blank texts are one group; repeated rows share theirs; texts of any length are read whole.
    Null keys: see near_duplicates. Empty table: no rows.
    """
    mark, mark2 = F.xxhash64(docs[text]).alias("h"), F.xxhash64(F.lit("text"), docs[text]).alias("g")
    every = max(1, docs.count() // 8000)
    sample = docs.select(mark.alias("t"), docs[text].cast("binary").alias("text")).filter(F.pmod("t", F.lit(every)) == 0)
    common, often = common_shingles(sample.dropDuplicates(["t"]), words=words)

    def run(slices):
        for texts in slices:
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts]
            marks = [signature(x) for x in sets]
            first = [prefix(x, similarity, common, often).view(np.int64) for x in sets]
            yield [
                pa.array(fingerprints(texts).view(np.int64)), pa.array([band_keys(s) for s in marks], pa.list_(pa.int64())), pa.array([s.astype(np.uint16).tobytes() for s in marks], pa.binary()),
                pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array([parities(x) for x in sets], pa.binary()),
            ]

    kinds = {"f": "bigint", "keys": "array<bigint>", "sig": "binary", "whole": "bigint", "n": "bigint", "prefix": "array<bigint>", "odd": "binary"}
    prints = map_texts(docs.select(mark, mark2, docs[key].alias("least"), docs[text].alias("text")), ["h", "g", "least"], F.col("text"), run, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    nodes = prints.groupBy("row.h", "row.g").agg(F.min("row.least").alias("least"), F.min("f").alias("f"), *[F.first(c).alias(c) for c in kinds if c != "f"])
    nodes = stored(nodes.withColumn("t", F.monotonically_increasing_id()))  # numbers, once written, that no two nodes share
    of_print = stored(nodes.groupBy("f").agg(F.min("t").alias("t")))
    same = nodes.select("t", "f").join(of_print.withColumnRenamed("t", "a"), "f").filter("t <> a").select("a", F.col("t").alias("b"))
    fuzzy = near_links(of_print.select("f"), bits=bits).join(of_print.select(F.col("f").alias("a"), F.col("t").alias("x")), "a").join(of_print.select(F.col("f").alias("b"), F.col("t").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    def held(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.explode(F.array("a", "b")).alias("t")).distinct()
        # the row of its least key holds each text
        texts = docs.select(docs[key].alias("least"), mark, mark2, docs[text].cast("binary").alias("text")).filter(F.col("text").isNotNull())
        of = nodes.select("t", "h", "g", F.col("least").alias("of")).join(ends, "t")
        texts = texts.join(of, ["h", "g"]).filter(F.col("least").eqNullSafe(F.col("of"))).dropDuplicates(["t"]).select("t", "text")
        return stored(confirmed(edges, full_sets(texts, words=words), similarity))

    def grouped(edges: DataFrame) -> DataFrame:
        return components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).withColumnRenamed("f", "t")

    # of texts with the same shingles (other case, spaces or order) one is compared
    one = stored(nodes.groupBy("whole").agg(F.min("t").alias("t")))
    equal = nodes.select("whole", "t").join(one.withColumnRenamed("t", "a"), "whole").filter("t <> a").select("a", F.col("t").alias("b"))
    ones = nodes.join(one.select("t"), "t").filter("n > 0")
    linked = held(stored(candidate_edges(ones.select("t", "keys", "sig"), least=similarity - 0.07, bucket=bucket)))
    root = grouped(same.unionByName(fuzzy).unionByName(equal).unionByName(linked))
    parts = ones.select("t", "n", "prefix", "odd").join(root, "t", "left").withColumn("part", F.coalesce("root", "t"))
    crossing = stored(crossing_edges(parts, similarity=similarity, bucket=bucket))
    if not crossing.isEmpty():
        root = grouped(root.select(F.col("root").alias("a"), F.col("t").alias("b")).unionByName(held(crossing)))
    named = nodes.select("t", "h", "g", "least").join(root, "t", "left").withColumn("root", F.coalesce("root", "t"))
    named = stored(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h", "g", "component_id"))
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), mark, mark2)
    return rows.join(named, ["h", "g"]).select("row", "component_id")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """near_duplicates over all documents; see there."""
    return near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "fingerprint", "component_id")
