"""Periodic runs of words, by direct lag scans for short periods and multi-scale minimizers for long ones."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import map_texts, table

LEAST, TIMES = 24, 3
LAGS = 32  # periods below are found by scans, one lag at a time
_ODD = 0x9E3779B97F4A7C15
_NONE = np.uint64((1 << 64) - 1)


class Words:
    """Numbered words of several texts in one array, the longest text first, each followed by a number of its own.

    No two words that are equal lie on different sides of such a border, so nothing periodic crosses it.
    """

    def __init__(self, texts: list[list[bytes]]):
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        self.sizes = np.array([len(texts[i]) for i in self.order], dtype=np.int64)
        ids = defaultdict(count(len(texts)).__next__)
        total = int(self.sizes.sum()) + len(texts)
        self.code = np.empty(total, dtype=np.int64)
        self.ends = np.cumsum(self.sizes + 1)
        self.starts = self.ends - self.sizes - 1
        for place, i in enumerate(self.order):
            a, e = int(self.starts[place]), int(self.ends[place]) - 1
            self.code[a:e] = np.fromiter(map(ids.__getitem__, texts[i]), np.int64, e - a)
            self.code[e] = place

    def upto(self, least: int) -> int:
        """Where the texts of at least so many words end."""
        n = int(np.searchsorted(-self.sizes, -least, "right"))
        return int(self.ends[n - 1]) if n else 0


def stretches(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of at least so many consecutive numbers in the rising `at`."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    long = end - begin >= least
    return at[begin[long]], at[end[long] - 1] + 1


def by_lags(code: np.ndarray, lags: range) -> np.ndarray:
    """Rows (start, end, period) of all stretches of a period in lags that are three times as long or more."""
    out = [np.zeros((0, 3), np.int64)]
    for q in lags:
        s, e = stretches(np.flatnonzero(code[q:] == code[:-q]), (TIMES - 1) * q)
        if len(s):
            out.append(np.stack([s, e + q, np.full(len(s), q)], axis=1))
    return np.concatenate(out)


class Hashes:
    """Hash of any stretch of codes in constant time: a polynomial modulo 2**64 in an odd number."""

    def __init__(self, code: np.ndarray):
        mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
        powers = lambda b, n: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers(base, len(code) - 1))])
        self.undo = powers(inverse, len(code))

    def of(self, at: np.ndarray | slice, to: np.ndarray | slice) -> np.ndarray:
        return (self.sums[to] - self.sums[at]) * self.undo[at]

    def forward(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How far the stretches from a and from b agree, room at most."""
        return self._agree(room, lambda n: self.of(a, a + n) == self.of(b, b + n))

    def backward(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        return self._agree(room, lambda n: self.of(a - n, a) == self.of(b - n, b))

    @staticmethod
    def _agree(room: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros_like(room), room.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            yes = same(middle)
            low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
        return low


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    low, step = key, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[: len(key) - width + 1], low[width - step : len(key) - step + 1])


def at_scale(hashes: Hashes, size: int, scale: int, known: np.ndarray) -> np.ndarray:
    """Pairs (position, period) of periods from scale to below twice that, one at least inside each run of such a smallest period among the first `size` words.

    Anchors are the least k-word strings of every window of `scale` words, k a quarter of it; strings that
    are themselves periodic (period k / 3 at most, read off the runs known from smaller scales) are passed over.
    A run of period q has q + 1 windows whose copies q words later lie inside as well. Were each of them periodic
    by a third of its length, so would the whole run be, and q not its smallest period; so one has an anchor, and
    its copy has the same anchor q words later. A string that isn't periodic recurs within twice the scale 24 times at most,
    so pairs of equal anchors stay few whatever the text.
    """
    k = scale // 4
    h = hashes.of(slice(0, size - k + 1), slice(k, size + 1))
    bits = max(1, int(size).bit_length())
    key = (h & ~np.uint64((1 << bits) - 1)) | np.arange(len(h), dtype=np.uint64)
    dull = known[(known[:, 2] * 3 <= k) & (known[:, 1] - known[:, 0] >= k)]
    edge = np.zeros(len(h) + 1, np.int64)
    dull = dull[dull[:, 0] < len(h)]
    np.add.at(edge, dull[:, 0], 1)
    np.add.at(edge, np.minimum(dull[:, 1] - k + 1, len(h)), -1)
    key[np.cumsum(edge[:-1]) > 0] = _NONE
    low = window_minima(key, scale - k + 1)
    low = low[np.concatenate([[True], low[1:] != low[:-1]]) & (low != _NONE)]
    at = np.unique((low & np.uint64((1 << bits) - 1)).astype(np.int64))
    own = h[at]
    order = np.argsort(own, kind="stable")
    at, own = at[order], own[order]
    out, step, left = [np.zeros((0, 2), np.int64)], 1, np.arange(len(at))
    while len(left := left[left + step < len(at)]):
        left = left[(own[left] == own[left + step]) & (at[left + step] - at[left] < 2 * scale)]
        far = left[at[left + step] - at[left] >= scale]
        out.append(np.stack([at[far], at[far + step] - at[far]], axis=1))
        step += 1
    return np.concatenate(out)


def extended(code: np.ndarray, hashes: Hashes, seeds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period): the seeds' stretches as far as the period holds, those of three periods or more; hashes propose, the words decide."""
    if not len(seeds):
        return np.zeros((0, 3), np.int64)
    seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
    a, q = seeds[:, 0], seeds[:, 1]
    follows = (q[1:] == q[:-1]) & (hashes.of(a[:-1], a[1:]) == hashes.of(a[:-1] + q[:-1], a[1:] + q[:-1]))  # of the same stretch as the seed before
    a, q = a[np.concatenate([[True], ~follows])], q[np.concatenate([[True], ~follows])]
    start = a - hashes.backward(a, a + q, a)
    end = a + q + hashes.forward(a, a + q, len(code) - a - q)
    out = np.unique(np.stack([start, end, q], axis=1)[end - start >= TIMES * q], axis=0)
    held = []
    for s, e, p in out.tolist():
        same = code[s + p : e] == code[s : e - p]
        if same.all():
            held.append((s, e, p))
        else:  # two hashes were equal by chance
            x, y = stretches(np.flatnonzero(same), (TIMES - 1) * p)
            held += [(s + i, s + j + p, p) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    return np.array(held, dtype=np.int64).reshape(-1, 3)


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text's words its runs, rows (start, length, smallest period), by start and period.

    A run of twice its smallest period is one of that many times too; of equal stretches the least
    period stays, as any other is a multiple of it.
    """
    words = Words(texts)
    known = by_lags(words.code[: words.upto(TIMES)], range(1, LAGS)) if words.upto(TIMES) else np.zeros((0, 3), np.int64)
    scale = LAGS
    size = words.upto(TIMES * scale)
    hashes = Hashes(words.code[:size]) if size else None
    while size:
        seeds = at_scale(hashes, size, scale, known)
        known = np.concatenate([known, extended(words.code[:size], hashes, seeds)])
        scale *= 2
        size = words.upto(TIMES * scale)
    known = known[known[:, 1] - known[:, 0] >= LEAST]
    known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
    new = np.concatenate([[True], (known[1:, :2] != known[:-1, :2]).any(axis=1)]) if len(known) else np.zeros(0, bool)
    known = known[new]
    place = np.searchsorted(words.ends, known[:, 0], "right")
    cut = np.searchsorted(place, np.arange(len(texts) + 1))
    out: list[np.ndarray] = [None] * len(texts)
    for j, i in enumerate(words.order):
        r = known[cut[j] : cut[j + 1]]
        r = np.stack([r[:, 0] - words.starts[j], r[:, 1] - r[:, 0], r[:, 2]], axis=1)
        out[i] = r[np.lexsort((r[:, 2], r[:, 0]))]
    return out


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    if not len(runs):
        return None
    r = runs[runs[:, 1] / runs[:, 2] >= (runs[:, 1] / runs[:, 2]).max() * (1 - 1e-12)]
    return min(map(tuple, r.tolist()), key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def planted(words: list[bytes], key: bytes | None) -> list[bytes]:
    """The words with the repetition that the contract's rule gives one key in ten; see op11_periods."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(key)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn, rest = divmod(n - a, p)
    unit = words[a : a + p]
    return words[:a] + unit * turn + unit[:rest]


def periodic_runs(docs: DataFrame, *, keep: list[str], text: str = "text", key: str | None = None, rewrite=None) -> DataFrame:
    """row (struct of keep), n_words, runs (array of start, length, period), best (the strongest run, or null), collapsed (binary text).

    Words are what stands between ASCII spaces and controls 9 to 13. A run is a stretch of words, as long as it can be, that
    repeats with a smallest period q: at least 24 words and 3 * q. Every run is found, of texts of any
    length, read whole; a text's own words alone decide, so nothing is shuffled. rewrite(words, key) -> words may change a
    text's words first; key is the decimal of an integer column, or None. Null texts have no words, like empty and blank ones: no runs, null best, empty collapsed.
    Repeated rows get equal results; columns of docs can have any names. Empty table: no rows.
    """
    held = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), (docs[key] if key else F.lit(None)).cast("long").cast("string").alias("key"), docs[text].cast("string").alias("text"))
    joined = F.concat(F.coalesce("key", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(slices):
        for texts in slices:
            parts = [t.as_buffer().to_pybytes().split(b"\n", 1) for t in texts]
            words = [b.split() for _, b in parts]
            if rewrite:
                words = [rewrite(w, k or None) for w, (k, _) in zip(words, parts, strict=True)]
            found = runs_of(words)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            ends = np.cumsum([0, *map(len, found)])
            best = [strongest(r) for r in found]
            yield [
                pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(pair))),
                pa.array([None if b is None else dict(zip(("start", "length", "period"), b, strict=True)) for b in best], pair),
                pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()),
            ]

    out = map_texts(held, ["row"], joined, run, f"n_words bigint, runs {kind}, best struct<start:bigint,length:bigint,period:bigint>, collapsed binary")
    return out.select(F.col("row.row").alias("row"), "n_words", "runs", "best", "collapsed")


def op11_periods(spark, sf_dir: str) -> DataFrame:
    """periodic_runs over all documents, whose words are rewritten first where crc32 of the key is divisible by 10; see there. Null keys: not rewritten."""
    found = periodic_runs(table(spark, sf_dir, "documents"), keep=["doc_id"], key="doc_id", rewrite=planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("(1000 * best.length) div best.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
