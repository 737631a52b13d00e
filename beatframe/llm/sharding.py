"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import stored, table

RING_SLOTS = 4096


def virtual_nodes(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(ring slot, shard), sorted; a shard's positions don't depend on how many other shards there are."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % RING_SLOTS
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def clockwise(nodes: list[tuple[int, int]], arc: int) -> list[int]:
    """The distinct shards met from a virtual node on, clockwise."""
    return list(dict.fromkeys(nodes[(arc + i) % len(nodes)][1] for i in range(len(nodes))))


def allot(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int, epsilon: float) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which keys of each arc stay and which continue clockwise.

    Works on one count for each arc, so its size is that of the ring. In round r the keys of an arc that
    are still without a place ask the r-th shard clockwise, which takes them up to its capacity.
    """
    total = sum(counts.values())
    if epsilon > 0:
        room = [math.ceil((1 + epsilon) * total / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    done = dict.fromkeys(counts, 0)
    filled = [0] * shards
    out = []
    order = {arc: clockwise(nodes, arc) for arc in counts}
    for r in range(shards):
        for arc in sorted(counts):
            s = order[arc][r]
            if n := min(counts[arc] - done[arc], room[s] - filled[s]):
                out.append((arc, done[arc], done[arc] + n, s, filled[s]))
                done[arc] += n
                filled[s] += n
    return out


def owners(spark, nodes: list[tuple[int, int]]) -> DataFrame:
    """ring, arc: the virtual node that owns each place of the ring, the next one clockwise."""
    starts = F.array(*[F.lit(p) for p, _ in nodes])
    return spark.range(RING_SLOTS).select(F.col("id").alias("ring"), (F.size(F.filter(starts, lambda p: p < F.col("id"))) % len(nodes)).alias("arc"))


def buckets_of(rows: DataFrame, largest: int, bucket_rows: int) -> DataFrame:
    """rows (arc, h, n) with bucket: parts of an arc in the order of h, of about bucket_rows rows. A hash that more rows share (equal ones) has buckets of its own, by the rows' numbers."""
    parts = 1 << max(0, math.ceil(math.log2(max(1, largest / bucket_rows))))
    often = stored(rows.groupBy("h").count().filter(F.col("count") > bucket_rows))
    part = F.pmod("h", F.lit(parts))
    plain = rows.join(often, "h", "left")
    own = F.when(F.col("count").isNotNull(), F.col("h")).otherwise(0)
    share = F.coalesce(F.pmod(F.xxhash64("n"), F.ceil(F.col("count") / bucket_rows)), F.lit(0))
    return plain.withColumn("bucket", F.struct(part.alias("part"), own.alias("own"), share.alias("share"))).drop("count")


def ranked(rows: DataFrame, largest: int, bucket_rows: int) -> DataFrame:
    """rows with rank: gapless from 0 in each arc, by bucket, h and number."""
    rows = buckets_of(rows, largest, bucket_rows)
    rank = F.row_number().over(Window.partitionBy("arc", "bucket").orderBy("h", "n")) - 1
    before = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("arc", "bucket").count().select("arc", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return rows.withColumn("rank", rank).join(base, ["arc", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))


def ring_shards(docs: DataFrame, *, shards: int = 8, vnodes: int = 32, epsilon: float = 0.0, key: str = "doc_id", text: str = "text", bucket_rows: int = 20_000) -> DataFrame:
    """One row for each row of docs: key, size, text_crc32, shard, slot.

    The key's hash is its place on the ring; the next virtual node clockwise owns it. A shard holds at
    most ceil((1 + epsilon) * rows / shards) rows (epsilon 0: counts at most one apart); keys beyond that
    continue clockwise. Slots are gapless from 0 in every shard.

    Null text: size 1, checksum of the empty string. Null keys hash like a value of their own. Repeated
    rows each get a slot; which of several identical rows gets which is of no matter, and no task ranks more than
    about bucket_rows rows, equal or not. Texts of any length count whole. Empty table: no rows. Extra columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    nodes = virtual_nodes(shards, vnodes)
    ring = owners(spark, nodes)
    bytes_ = F.coalesce(docs[text].cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(docs[key].alias(key), (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), F.monotonically_increasing_id().alias("n"))
    # written, so that a row keeps its number whoever reads it
    rows = stored(rows.select("*", F.pmod(F.xxhash64(F.lit("ring"), key), F.lit(RING_SLOTS)).alias("ring"), F.xxhash64(F.lit("rank"), key, "text_crc32", "size").alias("h")))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("ring").count().join(F.broadcast(ring), "ring").groupBy("arc").agg(F.sum("count").alias("n")).collect()}  # a row for each arc
    segments = allot(counts, nodes, shards, epsilon)
    rows = ranked(rows.join(F.broadcast(ring), "ring"), max(counts.values(), default=1), bucket_rows)
    fields = ("arc", "lo", "hi", "shard", "first")
    packed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(fields, s, strict=True)]) for s in segments or [(-1, 0, 0, 0, 0)]])
    of_arc = spark.range(1).select(F.explode(packed).alias("s")).select("s.*")
    return (
        rows.join(F.broadcast(of_arc.groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "first")).alias("segments"))), "arc")
        .withColumn("s", F.filter("segments", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0])
        .select(key, "size", "text_crc32", F.col("s.shard").alias("shard"), (F.col("s.first") + F.col("rank") - F.col("s.lo")).cast("long").alias("slot"))
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """ring_shards over all documents, 8 shards whose counts differ by one at most (law rows); see there."""
    out = ring_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
