"""MinHash near-dedup with odd sketches: banded candidates, similarities from parity bitmaps, links confirmed on full sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import map_texts, stored, table
from beatframe.llm.resemblance import WIDTH, buckets, common_shingles, confirmed, crossing_edges, full_sets, parities, prefix, shingle_set, signature
from beatframe.llm.simhash import components

BITS = 512  # of a sketch
BAND_ROWS = 8
_PLACE = np.arange(WIDTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of MinHash samples: each (number, value) flips one of BITS bits. 64-bit words.

    In the XOR of two sketches equal samples cancel out, so it is the sketch of those that differ.
    """
    x = (samples.astype(np.uint64) + _PLACE) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    at = (x >> np.uint64(64 - 9)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


def similarity_of(ones: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the population count of an XOR: d differing samples leave BITS / 2 * (1 - exp(-2 * 2d / BITS)) ones, as each gives two places."""
    d = -BITS / 4 * np.log1p(-np.minimum(2 * np.asarray(ones) / BITS, 1 - 1e-9))
    return np.maximum(1 - d / WIDTH, 0)


def most_ones(similarity: float) -> int:
    """The largest population count that similarity_of() puts at `similarity` or above."""
    return int(np.flatnonzero(similarity_of(np.arange(BITS // 2)) >= similarity).max(initial=-1))


def bands(samples: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(samples[a : a + BAND_ROWS].tobytes(), a) - (1 << 63) for a in range(0, WIDTH, BAND_ROWS)]


def nearest_forest(sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest over pairs of sketches whose XOR has at most so many ones; one row of comparisons at a time."""
    n = len(sketches)
    best, parent = np.full(n, BITS + 1), np.full(n, -1)
    rest = np.arange(n)
    edges = []
    while len(rest):
        i = int(np.argmin(best[rest]))
        at = int(rest[i])
        if best[at] <= most:
            edges.append((int(parent[at]), at))
        rest = np.delete(rest, i)
        ones = np.bitwise_count(sketches[rest] ^ sketches[at]).sum(axis=1, dtype=np.int64)
        closer = ones < best[rest]
        best[rest[closer]], parent[rest[closer]] = ones[closer], at
    return edges


def banded_edges(nodes: DataFrame, *, most: int, bucket: int) -> DataFrame:
    """a < b of nodes (t, keys of the bands, sketch): of every bucket of nodes that share a band the links that join it with fewest differences, as far as sketches allow."""
    met = stored(buckets(nodes, bucket))
    shares = max(1, math.ceil(met.count() / 20_000))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("t", "ascending")])
        key, node = np.asarray(t["key"]), np.asarray(t["t"])
        s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(key), -1)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair = {tuple(sorted((int(node[x + i]), int(node[x + j])))) for x, y in zip(cut, [*cut[1:], len(key)], strict=True) for i, j in nearest_forest(s[x:y], most)}
        return pa.table([[p[0] for p in pair], [p[1] for p in pair]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return met.join(nodes.select("t", "sketch"), "t").withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares))).groupBy("share").applyInArrow(compare, "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85, margin: float = 0.09, bucket: int = 4000) -> DataFrame:
    """row (struct of keep), n_shingles, component_id (the least key reachable over links), kept (its own key).

    A text's set are its distinct shingles of `words` words, A-Z in lower case; a shorter text is one shingle. Texts link where
    100 * intersection >= percent * union. Nodes are distinct sets. 128 MinHash samples of a set go into 16
    bands of 8 and, folded, into an odd sketch of 512 bits; inside a band's bucket the XOR counts of the sketches
    give the forest of closest pairs (estimate at least the threshold less margin), and full sets confirm them.
    Bands go by chance, so what they leave in different groups is compared without loss
    (resemblance.crossing_edges) and confirmed the same way: components are those of all links. Buckets above `bucket` are dealt out, none is cut.

    Null texts, and texts without words, have no shingles and link with nothing: each has its own key for
    component. Null keys never name a component, unless all its keys are null: then component_id is null; kept
    is true where key and component_id are equal, both null included. Repeated rows get equal results; texts of
    any length are read whole; columns of docs can have any names. Empty table: no rows.
    """
    similarity = percent / 100
    mark, mark2 = F.xxhash64(docs[text]).alias("h"), F.xxhash64(F.lit("text"), docs[text]).alias("g")
    every = max(1, docs.count() // 8000)
    sample = docs.select(mark.alias("t"), docs[text].cast("binary").alias("text")).filter(F.pmod("t", F.lit(every)) == 0)
    common, often = common_shingles(sample.dropDuplicates(["t"]), words=words)

    def run(slices):
        for texts in slices:
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts]
            samples = [signature(x) for x in sets]
            yield [
                pa.array([bands(s) for s in samples], pa.list_(pa.int64())), pa.array([odd_sketch(s).tobytes() for s in samples], pa.binary()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()), pa.array([prefix(x, similarity, common, often).view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([parities(x) for x in sets], pa.binary()),
            ]

    kinds = {"keys": "array<bigint>", "sketch": "binary", "whole": "binary", "n": "bigint", "prefix": "array<bigint>", "odd": "binary"}
    read = map_texts(docs.select(mark, mark2, docs[key].alias("least"), docs[text].alias("text")), ["h", "g", "least"], F.col("text"), run, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    nodes = read.groupBy("row.h", "row.g").agg(F.min("row.least").alias("least"), *[F.first(c).alias(c) for c in kinds])
    nodes = stored(nodes.withColumn("t", F.monotonically_increasing_id()))  # numbers, once written, that no two texts share
    one = stored(nodes.filter("n > 0").groupBy("whole").agg(F.min("t").alias("t"), F.count("*").alias("texts")))
    others = nodes.join(one.filter("texts > 1").select("whole", F.col("t").alias("first")), "whole").filter("t <> first").select("t")
    ones = nodes.filter("n > 0").join(stored(others), "t", "left_anti")  # few as a rule, so that nodes needn't be shuffled

    def held(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.explode(F.array("a", "b")).alias("t")).distinct()
        texts = docs.select(docs[key].alias("least"), mark, mark2, docs[text].cast("binary").alias("text")).filter(F.col("text").isNotNull())
        of = nodes.select("t", "h", "g", F.col("least").alias("of")).join(ends, "t")
        texts = texts.join(of, ["h", "g"]).filter(F.col("least").eqNullSafe(F.col("of"))).dropDuplicates(["t"]).select("t", "text")  # the row of its least key holds each text

        return stored(confirmed(edges, full_sets(texts, words=words), similarity))

    near = held(stored(banded_edges(ones.select("t", "keys", "sketch"), most=most_ones(similarity - margin), bucket=bucket)))
    root = components(near).withColumnRenamed("f", "t")
    parts = ones.select("t", "n", "prefix", "odd").join(root, "t", "left").withColumn("part", F.coalesce("root", "t"))
    crossing = stored(crossing_edges(parts, similarity=similarity, bucket=bucket))
    if not crossing.isEmpty():
        root = components(root.select(F.col("root").alias("a"), F.col("t").alias("b")).unionByName(held(crossing))).withColumnRenamed("f", "t")
    rooted = one.join(root, "t", "left").select("whole", F.coalesce("root", "t").alias("root"))
    named = nodes.select("h", "g", "n", "least", "whole").join(rooted, "whole", "left")  # none for texts without words
    ids = named.filter("root is not null").groupBy("root").agg(F.min("least").alias("id"))
    named = stored(named.join(ids, "root", "left").select("h", "g", "n", "id"))
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[key].alias("own"), mark, mark2).join(named, ["h", "g"])
    component = F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("own"))
    return rows.select("row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("own").eqNullSafe(component).alias("kept"))


def op13_oddsketch(spark, sf_dir: str) -> DataFrame:
    """similar_groups over all documents; see there."""
    return similar_groups(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "n_shingles", "component_id", "kept")
