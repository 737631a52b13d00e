"""Links between texts of a given Jaccard similarity over word shingles, for near-dedup beyond a few SimHash bits.

Bands of least hashes join most of them cheaply (candidate_edges, by chance); what they leave apart is
compared without loss where two texts share a shingle of their prefixes (crossing_edges).
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import stored

ROWS, BANDS, WIDTH = 5, 16, 128
LEAST_LEVEL = 8
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 32, WIDTH, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, WIDTH, dtype=np.uint32)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, a blank one none."""
    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    return np.unique(np.array([one(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))], dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least values of WIDTH hash functions."""
    out = np.full(WIDTH, (1 << 32) - 1, dtype=np.uint32)
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for a in range(0, len(h), 4096):
        x = h[None, a : a + 4096] * _A[:, None] + _B[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def parities(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls into each of as many places as there are shingles (the next power of two, 256 at least): sets that differ in d shingles differ in d places at most."""
    places = 1 << max(LEAST_LEVEL, int(len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).tobytes()


class Parities:
    """Parities of many sets, compared pair by pair. Of two sizes the larger is folded: halves laid over each other are the parities of half as many places."""

    def __init__(self, odd: list[bytes]):
        self.size = np.array([len(o) for o in odd], dtype=np.int64)
        self.rows, self.place = {}, {}
        of = {int(s): np.flatnonzero(self.size == s) for s in np.unique(self.size)}
        whole = {s: np.frombuffer(b"".join([odd[i] for i in at]), np.uint64).reshape(len(at), -1) for s, at in of.items()}
        for s in of:
            held, at = [whole[s]], [of[s]]
            if 2 * s in of:
                held.append(whole[2 * s][:, : s // 8] ^ whole[2 * s][:, s // 8 :])
                at.append(of[2 * s])
            self.rows[s] = np.concatenate(held)
            self.place[s] = np.full(len(odd), -1)
            self.place[s][np.concatenate(at)] = np.arange(sum(map(len, at)))

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many places sets x and y differ at least; sets whose sizes are more than one step apart differ in none."""
        out = np.zeros(len(x), np.int64)
        least = np.minimum(self.size[x], self.size[y])
        for s in np.unique(least):
            some = np.flatnonzero((least == s) & (np.maximum(self.size[x], self.size[y]) <= 2 * s))
            for a in range(0, len(some), step := max(1, (1 << 25) // int(s))):
                i = some[a : a + step]
                out[i] = np.bitwise_count(self.rows[s][self.place[s][x[i]]] ^ self.rows[s][self.place[s][y[i]]]).sum(axis=1)
        return out


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles in a fixed order of all (rarest first, by the counts `often` of the sorted `common`), as many as a text of that similarity can't miss all of."""
    n = len(shingles)
    if not n:
        return shingles
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        count = np.where(common[at] == shingles, often[at], 0)
    return shingles[np.lexsort((shingles, count))[: n - math.ceil(similarity * n * (1 - 1e-9)) + 1]]


def common_shingles(texts: DataFrame, *, words: int, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several of some sampled texts (column text, binary), and in how many. They decide an order, and no result."""

    def run(batches):
        for b in batches:
            found = [shingle_set(t.as_buffer().to_pybytes(), words) for t in b.column(0) if t.is_valid]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["h"])

    top = texts.select("text").mapInArrow(run, "h bigint").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = np.asarray(top["h"]).astype(np.int64).view(np.uint64), np.asarray(top["count"]).astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def crossing_edges(nodes: DataFrame, *, similarity: float, bucket: int = 4000) -> DataFrame:
    """a < b of nodes (t, part, n shingles, prefix, odd parities) of different parts: all pairs that can have the similarity asked for, and few others.

    With o shingles in common, o >= similarity * larger size, and o >= similarity / (1 + similarity) * both sizes.
    So the first common shingle lies in both prefixes, in the smaller set's at n - o at most, and as many as
    o shingles follow it in both. Pairs that meet there are compared by parities. Shingles whose texts are
    all of one part are left out. A shingle with more than `bucket` texts is compared block against block.
    """
    share_of = similarity / (1 + similarity) * (1 - 1e-9)
    short = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * F.lit(2 * share_of))
    rows = nodes.select("t", "part", "n", F.posexplode("prefix").alias("pos", "key")).withColumn("short", short)
    keys = rows.groupBy("key").agg(F.count("*").alias("count"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("short").alias("short"))
    keys = stored(keys.filter("lo <> hi and short").select("key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("t", "key"), F.col("blocks")).cast("int")
    met = rows.drop("short").join(keys, "key").withColumn("block", block)
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))).alias("other")
    met = met.select("t", "part", "n", "pos", "key", "block", other)
    met = stored(met.select("t", "part", "n", "pos", "block", (F.col("block") == F.col("other")).alias("own"), F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")))
    shares = max(1, math.ceil(met.count() / 20_000))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("part", "ascending")])
        key, part, node, n, pos, block = (np.asarray(t[c]) for c in ("key", "part", "t", "n", "pos", "block"))
        own = np.asarray(t["own"].cast(pa.int8()))
        odd = Parities(t["odd"].to_pylist())
        size = len(key)
        new_key = np.concatenate([key[1:] != key[:-1], [True]])
        new_part = new_key | np.concatenate([part[1:] != part[:-1], [True]])
        ends = np.arange(1, size + 1)
        stop = ends[new_key][np.searchsorted(ends[new_key], ends)]
        other = ends[new_part][np.searchsorted(ends[new_part], ends)]  # texts of other parts follow
        at = np.arange(size)
        found = []
        while len(at := at[other[at] < stop[at]]):
            to = other[at]
            least = share_of * (n[at] + n[to])
            ok = (np.minimum(n[at] - pos[at], n[to] - pos[to]) >= least) & (np.minimum(n[at], n[to]) >= least) & ((own[at] == 1) | (block[at] != block[to]))
            x, y = at[ok], to[ok]
            close = odd.differ(x, y) <= n[x] + n[y] - 2 * least[ok]
            x, y = node[x[close]], node[y[close]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            other[at] += 1
        pair = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    joined = met.join(nodes.select("t", "odd"), "t").withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares)))
    return joined.groupBy("share").applyInArrow(compare, "a bigint, b bigint").distinct()


def strongest_tree(s: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over the estimated similarities of at least `least`; one row of comparisons at a time."""
    n = len(s)
    best, parent = np.full(n, -1.0), np.full(n, -1)
    todo = np.ones(n, dtype=bool)
    edges = []
    for _ in range(n):
        at = int(np.argmax(np.where(todo, best, -2.0)))
        if best[at] >= least:
            edges.append((int(parent[at]), at))
        todo[at] = False
        rest = np.flatnonzero(todo)
        like = (s[rest] == s[at]).mean(axis=1)
        better = like > best[rest]
        best[rest[better]], parent[rest[better]] = like[better], at
    return edges


def band_keys(s: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(s[ROWS * j : ROWS * (j + 1)].tobytes(), j) - (1 << 63) for j in range(BANDS)]


def buckets(nodes: DataFrame, bucket: int) -> DataFrame:
    """key, t of nodes (t, keys of the bands) that share a band; of buckets with the same texts one is taken.

    A bucket above the limit is dealt into parts of about half the limit, twice by other hashes, so that
    parts of one deal overlap those of the other.
    """
    rows = nodes.select("t", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("count"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.bit_xor(F.xxhash64("t")).alias("x")).filter("count > 1")
    sizes = stored(sizes.groupBy("count", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "count"))
    met = rows.join(sizes, "key")
    parts = F.ceil(F.col("count") / F.lit(max(1, bucket // 2)))
    dealt = F.array(*[F.xxhash64("key", F.lit(i), F.pmod(F.xxhash64("t", F.lit(i)), parts)) for i in range(2)])
    return met.select(F.explode(F.when(F.col("count") > bucket, dealt).otherwise(F.array("key"))).alias("key"), "t")


def candidate_edges(nodes: DataFrame, *, least: float, bucket: int = 4000) -> DataFrame:
    """a < b of nodes (t, keys of the bands, sig): the strongest edges inside every bucket of texts that share a band, most of those that join similar texts but not all (see crossing_edges)."""
    met = stored(buckets(nodes, bucket))
    shares = max(1, math.ceil(met.count() / 20_000))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("t", "ascending")])
        key, node = np.asarray(t["key"]), np.asarray(t["t"])
        s = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, WIDTH)
        cut = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        pair = {tuple(sorted((int(node[x + i]), int(node[x + j])))) for x, y in zip(cut, [*cut[1:], len(key)], strict=True) for i, j in strongest_tree(s[x:y], least)}
        return pa.table([[p[0] for p in pair], [p[1] for p in pair]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return met.join(nodes.select("t", "sig"), "t").withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares))).groupBy("share").applyInArrow(compare, "a bigint, b bigint").distinct()


def full_sets(texts: DataFrame, *, words: int) -> DataFrame:
    """t, items (sorted 64-bit hashes of all shingles, as bytes) of texts (t, text): each text is read once, however many links it has."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                items = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words).tobytes() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(items, pa.binary())], names=["t", "items"])

    return stored(texts.select("t", "text").mapInArrow(run, "t bigint, items binary"))


def confirmed(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) whose full sets (t, items) have intersection / union of the similarity asked for, in whole numbers."""
    least = Fraction(similarity).limit_denominator(1000)
    above, below = least.numerator, least.denominator

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                if not len(p) or below * len(p) < above * len(q):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(below * both >= above * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    left = edges.join(sets.select(F.col("t").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("t").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")
