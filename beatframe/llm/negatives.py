"""Hard negatives by threshold joins: a pruned inverted index, remaining norms, and thresholds that go down until windows fill."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import stored, table
from beatframe.llm.products import LEAST, MOST, Best, exact, matrix, most_common_length, whole_numbers

STEP = 8  # dimensions that are accumulated between two looks at the bounds


def remaining(x: np.ndarray) -> np.ndarray:
    """Length of each row from each dimension on (and zero at the end)."""
    tail = np.sqrt(np.cumsum(np.square(x[:, ::-1]), axis=1))[:, ::-1]
    return np.concatenate([tail, np.zeros((len(x), 1))], axis=1)


class Index:
    """Postings of a block of candidates, by dimension, for queries that are no longer than `longest` and ask for scores of `least` or more.

    From the dimension on where a candidate's remaining length times `longest` falls short of `least`, it
    is left out: those dimensions alone can't reach the threshold, so a match has a product of at
    least some indexed dimension. Candidates stand in the order of how many (blocks of) dimensions they are
    indexed in, so a dimension's postings are the first of them. A candidate too short for any match is in none.
    """

    def __init__(self, x: np.ndarray, tail: np.ndarray, least: float, longest: float):
        held = (tail[:, :-1] * (longest * (1 + 1e-9)) >= least).sum(axis=1)
        blocks = -(-held // STEP)
        self.rows = np.argsort(-blocks, kind="stable")[: int((blocks > 0).sum())]
        self.counts = [int((blocks > b).sum()) for b in range(-(-x.shape[1] // STEP) + 1)]
        self.postings = np.ascontiguousarray(x[self.rows].T)
        self.tail = np.ascontiguousarray(tail[self.rows].T)
        self.width = x.shape[1]

    def matches(self, q: np.ndarray, q_tail: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) of all pairs that can reach the query's threshold: partial scores over indexed dimensions and remaining norms don't exclude them."""
        n = self.counts[0]
        score = np.zeros((len(q), n))
        slack = 1e-9 * (1 + q_tail[:, :1] * self.tail[:1])
        found = []

        def decide(a: int, e: int, d: int) -> np.ndarray:
            reach = score[:, a:e] + q_tail[:, d : d + 1] * self.tail[d : d + 1, a:e] + slack[:, a:e]
            return (reach >= least[:, None]) | (least[:, None] <= LEAST)  # scores that end at 64 bits lie above their products

        for b in range(len(self.counts) - 1):
            n = min(n, self.counts[b])
            if not n:
                break
            d, to = b * STEP, min((b + 1) * STEP, self.width)
            score[:, :n] += q[:, d:to] @ self.postings[d:to, :n]
            ends = min(n, self.counts[b + 1])
            found.append([*np.nonzero(decide(ends, n, to)), ends])  # those whose indexed dimensions are all summed up
            if ends and to in (self.width // 2, self.width * 3 // 4):
                alive = decide(0, ends, to)
                if alive.mean() < 0.02:  # few pairs are left: their full products are cheaper than going on
                    found.append([*np.nonzero(alive), 0])
                    break
        i = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
        j = np.concatenate([np.zeros(0, np.int64), *[f[1] + f[2] for f in found]])
        return i, self.rows[j]


class Asked:
    """Queries of a task: vectors, labels, rows, and slots (windows of scores) for each."""

    def __init__(self, x: np.ndarray, row: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.x, self.row, self.label, self.high = x, row, label, high
        self.real = x.astype(np.float64)
        self.tail = remaining(self.real)
        self.slots = low.shape[1]
        self.best = Best(low.ravel(), k)

    def least(self, some: np.ndarray | slice) -> np.ndarray:
        """The threshold of each query: the lowest of its windows that are not empty."""
        low = self.best.least.reshape(-1, self.slots)[some]
        return np.where(low <= self.high[some], low, MOST).min(axis=1, initial=MOST)

    def take(self, c: np.ndarray, ids: np.ndarray, row: np.ndarray, label: np.ndarray, *, same: bool, tile: int = 256) -> int:
        """Goes through candidates of the queries' label (same) or of any other; returns how many full products it took."""
        real = c.astype(np.float64)
        tail = remaining(real)
        full = 0
        for mark in np.unique(label) if same else [None]:
            of = np.flatnonzero(label == mark) if same else np.arange(len(c))
            who = np.flatnonzero(self.label == mark) if same else np.arange(len(self.x))
            for a in range(0, len(who), tile):
                some = who[a : a + tile]
                least = self.least(some).astype(np.float64)
                if not len(some) or least.min() >= MOST:
                    continue
                index = Index(real[of], tail[of], float(least.min()), float(self.tail[some, 0].max()))
                i, j = index.matches(self.real[some], self.tail[some], least)
                i, j = some[i], of[j]
                good = self.row[i] != row[j] if same else self.label[i] != label[j]
                i, j = i[good], j[good]
                for b in range(0, len(i), 1 << 15):
                    x, y = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
                    full += len(x)
                    score = exact(self.x[x], c[y])
                    for s in range(self.slots):
                        good = score <= self.high[x, s]
                        self.best.add(x[good] * self.slots + s, score[good], ids[y[good]], row[y[good]])
        return full


def _columns(table_: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """x, id, row, label of a batch."""
    x = table_["x"] if isinstance(table_, pa.RecordBatch) else table_["x"].combine_chunks()
    return matrix(x, width), *(np.asarray(table_[c]) for c in ("id", "row", "label"))


def joined(queries: DataFrame, candidates: DataFrame, *, width: int, k: int, same: bool, chunk_bytes: int, tile: int) -> DataFrame:
    """row (of the query), slot, c_id, c_row, score: the k best candidates of each of a query's windows of scores, of every task.

    queries: x, id, row, label, low and high (arrays, one number for each window; an empty window has low above high). They
    go to the tasks in chunks of chunk_bytes, one broadcast at a time; candidates stay where they are.
    """
    spark = queries.sparkSession
    queries = stored(queries)
    chunks = max(1, math.ceil(queries.count() * 8 * width / chunk_bytes))
    parts = []
    for chunk in range(chunks):
        some = queries.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).orderBy("label", "row").toArrow()
        if not len(some):
            continue
        x, _, row, label = _columns(some, width)
        ends = [np.asarray(some[c].combine_chunks().flatten(), dtype=np.int64).reshape(len(x), -1) for c in ("low", "high")]
        shared = spark.sparkContext.broadcast((x, row, label, *ends))

        def search(batches, shared=shared):
            asked = Asked(*shared.value, k)
            for b in batches:
                for a in range(0, b.num_rows, tile):
                    asked.take(*_columns(b.slice(a, tile), width), same=same)
            at, score, ids, rows = asked.best.held()
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (asked.row[at // asked.slots], at % asked.slots, ids, rows, score)], names=["row", "slot", "c_id", "c_row", "score"])

        parts.append(stored(candidates.select("x", "id", "row", "label").mapInArrow(search, "row bigint, slot bigint, c_id bigint, c_row bigint, score bigint")))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], "row bigint, slot bigint, c_id bigint, c_row bigint, score bigint, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "c_id", "c_row"))  # of each task's k best
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_thresholds(sample: pa.Table, width: int, total: int, positives: int, enough: int):
    """Kernels over queries: for positives, the score of the positives-th best of the sample (a bound that surely fills); for windows, the score that about `enough` of all rows should reach."""
    x, ids, row, label = _columns(sample, width)
    share = len(x) / max(1, total)
    real = x.astype(np.float64)
    reach = max(1, math.ceil(enough * share))

    def positive(batches):
        for b in batches:
            q, _, own, mark = _columns(b, width)
            asked = Asked(q, own, mark, np.full((len(q), 1), LEAST), np.full((len(q), 1), MOST), positives)
            asked.take(x, ids, row, label, same=True)
            low = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32), pa.array(asked.best.least))
            yield pa.RecordBatch.from_arrays([*b.columns, low], names=[*b.schema.names, "low"])

    def windows(batches):
        for b in batches:
            q, _, _, mark = _columns(b, width)
            size = len(q)
            floor, high = (np.asarray(b[c].flatten(), dtype=np.int64).reshape(size, -1) for c in ("floor", "high"))
            low = floor.copy()
            for a in range(0, size, 64):
                score = np.where(mark[a : a + 64, None] != label[None], q[a : a + 64].astype(np.float64) @ real.T, -np.inf)
                for s in range(floor.shape[1]):
                    lo, hi = floor[a : a + 64, s], high[a : a + 64, s]
                    inside = np.where((score >= lo[:, None]) & (score <= hi[:, None]), score, -np.inf)
                    top = np.partition(inside, -min(reach, len(x)), axis=1)[:, -min(reach, len(x))]
                    low[a : a + 64, s] = np.where(np.isfinite(top), np.clip(top, lo, np.maximum(lo, hi)), lo)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * floor.shape[1], pa.array(low.ravel()))], names=[*b.schema.names, "low"])

    return positive, windows


def hard_negatives(vectors: DataFrame, *, positives: int = 5, negatives: int = 3, every: int = 50, ids: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256, sample_rows: int = 4096, enough: int = 24, chunk_bytes: int = 64_000_000, tile: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by `every`; scores are integer inner products of floor(scale * x). An
    anchor's positives are its `positives` best other rows of its label; for each, the best `negatives` rows of
    another label with 50 * positive_score <= 100 * score <= 95 * positive_score (none where positive_score is negative).

    Both are threshold joins (see Index). Positives start from a threshold that the sample (sample_rows rows of
    least hash) surely fills. Windows start from the score that about `enough` rows should reach, by
    the sample; those that don't fill go on with a threshold four times as far below their upper end, at
    last their lower end. So every window is filled, or searched down to its end. Tasks raise thresholds as they fill
    their own windows; only their best go on.

    Left out: null ids, null labels, null vectors, vectors with null or non-finite components, and vectors of another
    length than the most common. Rows that repeat an id are rows of their own: each is an anchor, and a candidate of the
    others. Ties go to the smaller id. Scores beyond 64 bits are the nearest that fits. Columns of vectors can have any names. Empty table: no rows.
    """
    spark = vectors.sparkSession
    x = stored(whole_numbers(vectors, ids=ids, vector=vector, scale=scale, also={"label": (F.col(label) if isinstance(label, str) else label).cast("long")}).filter("label is not null"))
    width = most_common_length(x)
    x = x.filter(F.size("x") == width)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not width:
        return spark.createDataFrame([], out)
    sample = x.orderBy(F.xxhash64("x"), "id", "row").limit(sample_rows).toArrow()
    positive, windows = first_thresholds(sample, width, x.count(), positives, enough)
    plain = "x array<bigint>, id bigint, row bigint, label bigint"
    anchors = stored(x.filter(F.col("id") % every == 0).select("x", "id", "row", "label"))
    sizes = {"width": width, "chunk_bytes": chunk_bytes, "tile": tile}
    asked = anchors.mapInArrow(positive, f"{plain}, low array<bigint>").withColumn("high", F.array(F.lit(MOST)))
    found = stored(joined(asked, x, k=positives, same=True, **sizes))

    floor = F.expr("if(score < 0, 1, score - score div 2)")  # half of it, rounded up
    high = F.expr("if(score < 0, 0, score - score div 20 - if(score % 20 = 0, 0, 1))")  # 95 % of it, rounded down
    ends = F.struct((F.col("rank") - 1).alias("slot"), F.struct(floor.alias("floor"), high.alias("high")))
    slots = found.groupBy("row").agg(F.map_from_entries(F.collect_list(ends)).alias("ends"))
    every_slot = F.sequence(F.lit(0), F.lit(positives - 1))
    end = lambda name, none: F.transform(every_slot, lambda s: F.coalesce(F.try_element_at("ends", s)[name], F.lit(none).cast("long")))
    asked = anchors.join(slots, "row").select("x", "id", "row", "label", end("floor", 1).alias("floor"), end("high", 0).alias("high"))
    asked = stored(asked.mapInArrow(windows, f"{plain}, floor array<bigint>, high array<bigint>, low array<bigint>"))
    answers = []
    while not asked.isEmpty():
        got = stored(joined(asked.drop("floor"), x, k=negatives, same=False, **sizes))
        full = got.groupBy("row", "slot").count().filter(F.col("count") >= negatives).groupBy("row").agg(F.collect_set("slot").alias("full"))
        left = asked.join(full, "row", "left")
        done = lambda s: (F.get("low", s) <= F.get("floor", s)) | (F.get("low", s) > F.get("high", s)) | F.coalesce(F.array_contains("full", s.cast("long")), F.lit(False))
        left = stored(left.withColumn("done", F.filter(every_slot, done)))
        answers.append(got.join(left.select("row", F.explode(F.col("done").cast("array<bigint>")).alias("slot")), ["row", "slot"]))
        gap = lambda s: F.get("high", s) - F.get("low", s)
        lower = lambda s: F.when(gap(s) > (F.get("high", s) - F.get("floor", s)) / 4 - 1, F.get("floor", s)).otherwise(F.get("high", s) - 4 * gap(s) - 1)
        ended = lambda s: F.array_contains("done", s)
        rest = left.filter(F.size("done") < positives)
        goes_on = lambda then, value: F.transform(every_slot, lambda s: F.when(ended(s), F.lit(then).cast("long")).otherwise(value(s)))
        asked = stored(rest.select("x", "id", "row", "label", goes_on(1, lambda s: F.get("floor", s)).alias("floor"), goes_on(0, lambda s: F.get("high", s)).alias("high"), goes_on(1, lower).alias("low")))
    if not answers:
        return spark.createDataFrame([], out)
    all_ = answers[0]
    for a in answers[1:]:
        all_ = all_.unionByName(a)
    of = found.select("row", (F.col("rank") - 1).cast("long").alias("slot"), F.col("c_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return all_.join(of, ["row", "slot"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("c_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """hard_negatives over all embeddings, where vec_ids divisible by 7 have the next label of ten; see there."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label)
