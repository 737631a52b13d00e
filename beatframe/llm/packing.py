"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import stored, table

#: Permitted sequence lengths.
CAPACITIES = tuple(range(512, 4097, 512))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def cost(capacity: int) -> float:
    """What a sequence costs: the tokens that are computed for it, padding included, and a fixed part."""
    return capacity + 8


def expected(length: int, size: int, left: dict[int, int], lengths: int) -> int:
    """What a bin of that size would hold if it took this length, and then the longest of those that are left, again and again."""
    room, used = size - length, length
    taken = {length: 1}
    while fit := lengths & ((1 << (room + 1)) - 1):
        n = fit.bit_length() - 1
        most = min(left[n] - taken.get(n, 0), room // n)
        if most:
            used, room = used + most * n, room - most * n
            taken[n] = taken.get(n, 0) + most
        lengths = fit & ~(1 << n)
    return used


def best_fit(lengths: list[int], capacities: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each length, none above the largest capacity.

    Longest first, each into the open bin that it leaves with the least room (the one that opened last, of several).
    Where none has room, all permitted sizes are weighed by what is left to pack: each size's cost, once it has
    shrunk to its expected contents, for each token of them; the least one opens, the smaller on ties. In
    the end each bin shrinks to the least permitted size that holds its contents.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left: dict[int, int] = {}
    for n in lengths:
        if n:
            left[n] = left.get(n, 0) + 1
    some = sum(1 << n for n in left)  # bit n: a piece of length n is left
    used: list[int] = []
    open_with: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    where = [(0, 0)] * len(lengths)
    least = lambda u: capacities[bisect_left(capacities, max(1, u))]
    for i in order:
        n = lengths[i]
        if over := rooms >> n:
            room = n + (over & -over).bit_length() - 1
            b = open_with[room].pop()
            if not open_with[room]:
                rooms &= ~(1 << room)
        else:
            weighed = []
            for c in capacities:
                if c >= n:
                    u = expected(n, c, left, some) if n else 0
                    weighed.append((cost(least(u)) / max(1, u), c))
            room = min(weighed)[1]
            b = len(used)
            used.append(0)
        where[i] = (b, used[b])
        used[b] += n
        if n:
            left[n] -= 1
            if not left[n]:
                some &= ~(1 << n)
        if rest := room - n:
            open_with.setdefault(rest, []).append(b)
            rooms |= 1 << rest
    final = [least(u) for u in used]
    return [(b, final[b], offset) for b, offset in where]


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, tokens=word_count, group_items: int = 50_000, copy_block: int = 10_000) -> DataFrame:
    """key, copy, piece, start, n_tokens, bin_id, bin_capacity, bin_offset: where every token of docs goes.

    A document longer than the largest capacity is cut into pieces of it and a rest. Pieces are dealt by
    hash into groups of about group_items, and each is packed by best fit in one task; bins of several
    groups never mix, which costs at most a few open bins for each group. No piece is dropped.

    Null and empty texts have one piece of 0 tokens. Repeated rows are told apart by copy (from 1) and
    are packed each; copy_block of them at most are made in one place. Null keys are a value of their own. Texts of any length are cut and packed whole. Empty
    table: no rows.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(tokens(F.col(text)), F.lit(0)).alias("n"), F.xxhash64(text).alias("h"))
    rows = stored(rows.groupBy("key", "n", "h").count())  # words are counted once
    pieces = rows.agg(F.sum(F.col("count") * F.greatest(F.ceil(F.col("n") / most), F.lit(1)))).first()[0] or 0
    groups = max(1, math.ceil(pieces / group_items))
    # equal rows are one row with a count; many come back in blocks that are dealt out, so that no task makes all of them
    blocks = rows.filter(F.col("count") > copy_block).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"), F.lit(copy_block).cast("long"))))
    blocks = blocks.repartition(F.col("key"), F.col("h"), F.col("first"))
    single = rows.filter(F.col("count") <= copy_block).withColumn("first", F.lit(1).cast("long"))
    last = F.least(F.col("first") + copy_block - 1, F.col("count"))
    items = (
        single.unionByName(blocks).withColumn("copy", F.explode(F.sequence(F.col("first"), last)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most).cast("int") - 1, F.lit(0)))))
        .select("key", "copy", "h", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("n_tokens"))
        .withColumn("group", F.pmod(F.xxhash64("key", "copy", "h", "piece"), F.lit(groups)).cast("int"))
    )

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("key", "ascending"), ("h", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        where = best_fit(t["n_tokens"].to_pylist(), capacities)
        group = t["group"][0].as_py()
        out = t.select(["key", "copy", "piece", "start", "n_tokens"])
        for name, values, kind in (("bin_id", [f"{group}-{b}" for b, _, _ in where], pa.string()), ("bin_capacity", [c for _, c, _ in where], pa.int32()), ("bin_offset", [o for _, _, o in where], pa.int32())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    kind = dict(rows.dtypes)["key"]
    out = items.groupBy("group").applyInArrow(packed, f"key {kind}, copy bigint, piece int, start int, n_tokens int, bin_id string, bin_capacity int, bin_offset int")
    return out.withColumnRenamed("key", key)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """pack over all documents; see there."""
    return pack(table(spark, sf_dir, "documents"))
