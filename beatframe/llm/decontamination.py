"""Benchmark decontamination by a prefix-filtered set join with exact verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import id_list_sha256, map_texts, stored, table

#: Digits, a-z and every byte of a non-ASCII character stay; A-Z become a-z; all else separates words.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
SHINGLE = 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


@dataclass
class Block:
    """A bounded part of the benchmark: its words, windows and shingles."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[list[str]]
    shingles: np.ndarray
    at: list[list[tuple[int, int]]]  # of each window: (shingle, offset)
    prefix: dict[int, list[tuple[int, int]]] | None = None  # of each shingle: (window, offset) that must meet there


def shingle_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """One key for each n consecutive word ids, in uint64 arithmetic; equal keys of other words are told apart later."""
    m = max(0, len(ids) - n + 1)
    key = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        key = (key ^ ids[j : j + m].astype(np.uint64)) * _MIX[j]
        key ^= key >> np.uint64(29)
    return key


def make_block(rows: list, window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in item_words(text)]
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1 if n else 0):
            found.setdefault(tuple(ids[i : i + n]), set()).add(item)
    windows = [np.array(w, dtype=np.int32) for w in found]
    keys = [shingle_keys(w, min(SHINGLE, len(w))) for w in windows]
    shingles = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    at = [[(int(s), o) for o, s in enumerate(np.searchsorted(shingles, k))] for k in keys]
    return Block(vocabulary, windows, [sorted(x) for x in found.values()], shingles, at)


def tokenised(block: Block, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts one after another (0: no benchmark word), and where each text begins."""
    known, ids, begin = block.vocabulary.get, [], [0]
    for t in texts:
        if t.is_valid:
            ids += [known(w, 0) for w in t.as_buffer().to_pybytes().translate(_WORD).split()]
        begin.append(len(ids))
    return np.array(ids, dtype=np.int32), np.array(begin, dtype=np.int64)


def met(block: Block, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, shingle) wherever a benchmark shingle stands inside one text."""
    where, which = [], []
    for n in sorted({min(SHINGLE, len(w)) for w in block.windows}):
        m = max(0, len(ids) - n + 1)
        full = np.ones(m, dtype=bool)
        for j in range(n):
            full &= ids[j : j + m] > 0
        p = np.flatnonzero(full)
        text = np.searchsorted(begin, p, "right")
        p = p[p + n <= begin[np.minimum(text, len(begin) - 1)]]
        if not len(p):
            continue
        key = np.full(len(p), n, dtype=np.uint64)
        for j in range(n):
            key = (key ^ ids[p + j].astype(np.uint64)) * _MIX[j]
            key ^= key >> np.uint64(29)
        s = np.searchsorted(block.shingles, key)
        s[s == len(block.shingles)] = 0
        same = block.shingles[s] == key
        where.append(p[same])
        which.append(s[same])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(where), np.concatenate(which)


def hits(block: Block, texts: pa.Array) -> list[pa.Array]:
    """n_words, hit runs and item ids of each text."""
    ids, begin = tokenised(block, texts)
    where, which = met(block, ids, begin)
    cover = np.zeros(len(ids) + 1, dtype=np.int32)
    items: dict[int, set[str]] = {}
    starts: dict[int, list[np.ndarray]] = {}
    order = np.argsort(which, kind="stable")
    where, which = where[order], which[order]
    cut = np.flatnonzero(np.diff(which, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(which)), strict=len(cut) > 0):
        for w, offset in block.prefix.get(int(which[a]), ()):
            starts.setdefault(w, []).append(where[a:b] - offset)
    for w, s in starts.items():
        words = block.windows[w]
        s = np.concatenate(s)
        text = np.searchsorted(begin, np.maximum(s, 0), "right") - 1
        s, text = (x[(s >= 0) & (s + len(words) <= len(ids))] for x in (s, text))  # length bound
        fits = s + len(words) <= begin[text + 1]  # positional bound: the window lies inside one text
        s, text = s[fits], text[fits]
        for j, x in enumerate(words):
            same = ids[s + j] == x
            s, text = s[same], text[same]
        np.add.at(cover, s, 1)
        np.add.at(cover, s + len(words), -1)
        for t in np.unique(text):
            items.setdefault(int(t), set()).update(block.items[w])
    hit = np.cumsum(cover)[:-1] > 0
    runs = []
    for i in range(len(texts)):
        h = np.diff(hit[begin[i] : begin[i + 1]].astype(np.int8), prepend=0, append=0)
        runs.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(h == 1), np.flatnonzero(h == -1), strict=True)])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return [pa.array(np.diff(begin)), pa.array(runs, span), pa.array([sorted(items.get(i, ())) for i in range(len(texts))], pa.list_(pa.string()))]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """row (struct of keep), n_words, hits (runs of words inside a benchmark window) and item_ids of each document.

    A set join: a document must contain a window's shingles, all of them. One pass over all documents
    counts every benchmark shingle; a window's prefix is its rarest shingle, as for full containment one
    is necessary. A second pass joins prefixes to documents, applies the bounds and verifies each window
    word by word. The benchmark is taken in blocks of about block_bytes of its distinct rows; of several, only
    one is broadcast at a time: what a block finds is written as a table, and its broadcasts destroyed.

    Null or empty texts have no words and no hits; texts of any length are read whole; items without words or
    without id have no windows; repeated items count once; repeated documents get equal rows. Empty tables give
    no rows, or no hits.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).dropna().distinct()
    blocks = max(1, math.ceil((bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        block = make_block([(r["item"], bytes(r["text"])) for r in bench.filter(F.col("block") == b).orderBy("item", "text").collect()], window)
        plain = spark.sparkContext.broadcast(block)

        def count(slices, plain=plain):
            for texts in slices:
                n = np.bincount(met(plain.value, *tokenised(plain.value, texts))[1])
                some = np.flatnonzero(n)
                pad = pa.nulls(len(texts) - 1, pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int64())])))
                yield [pa.concat_arrays([pa.array([[{"s": int(s), "n": int(n[s])} for s in some]], pad.type), pad])]

        counts = map_texts(docs.select(F.lit(0).alias("z"), F.col(text).alias("text")), ["z"], F.col("text"), count, "c array<struct<s:int,n:bigint>>")
        seen = {r["s"]: r["n"] for r in counts.select(F.explode("c").alias("c")).groupBy("c.s").agg(F.sum("c.n").alias("n")).collect()}  # a row for each shingle of the block at most
        block.prefix = {}
        for w, shingles in enumerate(block.at):
            s, offset = min(shingles, key=lambda x: (seen.get(x[0], 0), x))
            if s in seen:
                block.prefix.setdefault(s, []).append((w, offset))
        full = spark.sparkContext.broadcast(block)

        def find(slices, full=full):
            for texts in slices:
                yield hits(full.value, texts)

        schema = "n_words bigint, hits array<struct<start:int,end:int>>, item_ids array<string>"
        if out is None:
            out = map_texts(docs, keep, docs[text], find, schema) if blocks == 1 else map_texts(docs, keep_and_text(keep, text), docs[text], find, schema)
        else:
            again = out.select(*[F.col(c).alias(f"{c}{b}") for c in out.columns], F.col(f"row.{text}").alias("text"))
            more = map_texts(again, [f"{c}{b}" for c in out.columns], again["text"], find, schema)
            out = more.select(F.col(f"row.row{b}").alias("row"), "n_words", F.concat("hits", f"row.hits{b}").alias("hits"), F.array_union("item_ids", f"row.item_ids{b}").alias("item_ids"))
        if blocks > 1:
            out = stored(out)
            plain.destroy()
            full.destroy()
    return out


def keep_and_text(keep: list[str], text: str) -> list[str]:
    return keep if text in keep else [*keep, text]


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """contaminated over all documents and the whole benchmark; see there."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    words = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1)))
    n_hit = F.when(F.size("hits") == 0, 0).otherwise(F.size(F.array_distinct(words))).cast("long")
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        id_list_sha256(F.array_sort("item_ids")).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
