"""Suffix-array dedup: byte strings of a given length that stand anywhere else."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beatframe.llm.common import table
from beatframe.llm.repeats import Unit, base, before, repeated_spans, runs, without


def suffix_array(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, by Larsson-Sadakane refinement; equal ones by position.

    symbols are small, with a 0 behind each piece; ends[i] is where position i's piece ends. Groups of
    suffixes that agree so far are sorted by the group of what follows; what is alone in its group isn't
    touched again. Sort keys end in the position, so plain sorts keep the order of equal ones.
    """
    n = len(symbols)
    place = int(n).bit_length()  # bits of a position in sort keys
    low, at = np.int64((1 << place) - 1), np.arange(n)
    bits = int(symbols.max()).bit_length()
    h = (63 - place) // bits
    padded = np.append(symbols, np.zeros(h, symbols.dtype)).astype(np.int64)
    key, live = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    for j in range(h):
        x = padded[j : j + n] * live
        live &= x > 0
        key = (key << bits) | x
    key = np.sort((key << place) | at)
    sa = key & low
    key >>= place
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, at, 0)) + 1
    while h < depth:
        alone = new.copy()
        alone[:-1] &= new[1:]
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        s = sa[todo]
        after = np.where(s + h < ends[s], rank[np.minimum(s + h, n - 1)], 0)
        # groups stand in place: the first of a group has its rank, which orders keys as well as any number of groups
        group = np.cumsum(new[todo])
        if len(todo) and int(group[-1]).bit_length() + 2 * place <= 63:
            key = np.sort((((group << place) | after) << place) | s)
            s = key & low
            key >>= place
        else:
            key = (group << 32) | after
            order = np.argsort(key, kind="stable")
            s, key = s[order], key[order]
        sa[todo] = s
        first = np.ones(len(todo), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        new[todo] = first
        rank[s] = np.maximum.accumulate(np.where(first, todo, 0)) + 1
        h *= 2
    return sa


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, most: int, lanes: int = 1024) -> np.ndarray:
    """Of each suffix in order, the symbols it shares with the one before, up to `most`: Kasai's method, many stretches of the text in step.

    sa must be complete, with suffixes that are equal to their pieces' ends by position. From one position to the next the shared length falls by one at most, so each stretch compares about twice its length.
    """
    n = len(symbols)
    before = np.full(n, n, dtype=np.int64)  # nothing is before the first; padding matches nothing
    before[sa[1:]] = sa[:-1]
    padded = np.append(symbols, np.zeros(most + 1, symbols.dtype))
    size = -(-n // min(lanes, n))
    i = np.arange(0, n, size)
    stop = np.minimum(i + size, n)
    h = np.zeros(len(i), dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    while len(i):
        x = padded[i + h]
        more = (x == padded[before[i] + h]) & (x != 0) & (h < most)
        out[i] = h
        h += np.where(more, 1, -1)
        np.maximum(h, 0, out=h)
        i = i + ~more
        left = i < stop
        if not left.all():
            i, h, stop = i[left], h[left], stop[left]
    return out[sa]


def repeated_windows(t: pa.Table, unit: Unit) -> list[list[tuple[int, int]]]:
    """Spans of each stretch, in units from its anchor, whose windows also stand at another place of this shard.

    One suffix array holds all stretches of the shard. Suffixes whose common prefixes reach the window are a
    run; its windows are repeats if they stand at more than one place.
    """
    pieces = [x or b"" for x in t["piece"].to_pylist()]
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    used = np.zeros(256, dtype=np.uint16)
    used[np.unique(data)] = 1
    symbols = (np.cumsum(used, dtype=np.uint16) * used)[data]  # dense codes keep the order of bytes
    symbols[begin[1:] - 1] = 0
    piece = np.repeat(np.arange(len(pieces)), size + 1)
    ends = begin[piece] + size[piece]
    sa = suffix_array(symbols, ends, int(size.max()) + 1)
    shared = common_prefixes(symbols, sa, unit.window)
    run = np.cumsum(shared < unit.window)
    same = np.flatnonzero(np.bincount(run, minlength=len(sa) + 1)[run] > 1)
    key, mark, loc = (np.asarray(t[c]) for c in ("k", "m", "loc"))
    left, start = before(loc), base(loc)
    s = sa[same]
    k, m = key[piece[s]], mark[piece[s]]
    place = start[piece[s]] + (s - begin[piece[s]])
    first = np.searchsorted(run[same], run[same], "left")
    other = (k != k[first]) | (m != m[first]) | (place != place[first])
    repeated = np.isin(run[same], run[same][other])
    change = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(change, s[repeated], 1)
    np.add.at(change, s[repeated] + unit.window, -1)
    gone = np.cumsum(change)[:-1] > 0
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for a, b in runs(gone):
        i = int(piece[a])
        out[i].append((a - int(begin[i] + left[i]), b - int(begin[i] + left[i])))
    return out


def dedup_bytes(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text", window: int = 200, k: int = 48, full: bool = False) -> DataFrame:
    """row (struct of keep), n_units (bytes), n_removed, n_spans, kept_sha256 (and kept with full): docs without the bytes of every string of `window` bytes that also starts anywhere else.

    Null texts count as empty. Rows that repeat key and text are copies of each other. Null keys are a
    value of their own. Texts of any length are read whole. Empty table: no rows.
    """
    unit = Unit(words=False, window=window, k=k)
    spans = repeated_spans(docs, key=key, text=text, unit=unit, judge=repeated_windows, keep_first=False, shard_units=400_000)
    return without(docs, spans, keep=keep, key=key, text=text, unit=unit, full=full)


def op3_suffixes(spark, sf_dir: str) -> DataFrame:
    """dedup_bytes over all documents; see there."""
    out = dedup_bytes(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.selectExpr("row.doc_id", "n_units as n_bytes", "n_removed", "n_spans", "kept_sha256")
