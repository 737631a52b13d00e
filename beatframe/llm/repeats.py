"""Exact repeats of long passages: anchors route equal windows together, suffix structures judge them.

A unit is a word or a byte, a window is `window` consecutive units of one text. A window's anchor is the
k-unit string of least hash in it (the first, of equal ones), so equal windows have equal anchors at equal
places. An anchor's surroundings are the windows that have it: a stretch of the text, and every window is in
one stretch. Surroundings that are equal are counted before anything else moves: of any number of copies,
the first stands for all. All that have other surroundings of the same anchor go to a suffix structure,
shard by shard. An anchor with more surroundings than one shard holds is taken apart: its windows meet by longer
strings around the anchor, in the end by themselves, in as many tasks as there are.

A text is known by its key k, a hash m and 15 more bits of another hash. A place is packed in loc: those 15
bits, the anchor's position in the text (32 bits), the units of its stretch before it and the windows after
the stretch's first (8 bits each).
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatframe.functions.tables import forget
from beatframe.llm.common import map_texts, stored

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Word hashes are differences of prefix sums of bytes times powers of this, and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = (1 << 32) - 1
_LOW = np.uint64(_POSITION)


@dataclass(frozen=True)
class Unit:
    words: bool
    window: int
    k: int

    def __post_init__(self):
        if not 0 <= self.window - self.k < 256:
            raise ValueError("a window has its anchor and 255 units more at most")

    def split(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text with single spaces, and where each unit begins (with the end as last)."""
        if not self.words:
            return text, np.arange(len(text) + 1)
        w = text.split()
        at = np.zeros(len(w) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1, out=at[1:])
        return b" ".join(w), at

    def between(self, at: np.ndarray, a, b):
        """Byte range of units a to b."""
        return at[a], at[b] - self.words


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(27))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def unit_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    p, inverse = powers(len(data), _BASE), powers(len(data), _INVERSE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, dtype=np.uint64)])
    a, b = at[:-1], at[1:] - 1
    return mixed((sums[b] - sums[a]) * inverse[a] * _M1)


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over every w consecutive values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def byte_grams(data: bytes, k: int) -> np.ndarray:
    """A hash of every k consecutive bytes, k a multiple of 8, from eight bytes at a time."""
    n = len(data) - 7
    if len(data) < k:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((n,), "<u8", data, strides=(1,)) * _M1
    eight ^= eight >> np.uint64(32)
    m = len(data) - k + 1
    out = eight[:m].copy()
    for j in range(8, k, 8):
        out *= _M2
        out += eight[j : j + m]
    return mixed(out * _M1)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive unit hashes, by doubling."""
    out, done = None, 0
    power, width = h, 1
    while True:
        if k & width:
            out = power if out is None else mixed(out[: len(power) - done] * _M1 + power[done:]) if len(power) > done else out[:0]
            done += width
        if done == k:
            return out[: max(0, len(h) - k + 1)]
        if len(power) <= width:
            return h[:0]
        power, width = mixed(power[:-width] * _M1 + power[width:]), width * 2


def anchors(texts: list[bytes], unit: Unit) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, digest of its surroundings, place) of each text's anchors, all texts at once."""
    if unit.words:
        parts = [unit.split(t) for t in texts]
        n = np.array([len(at) - 1 for _, at in parts], dtype=np.int64)
        joined = b" ".join(p for p, _ in parts if p) + b" "
        base = np.concatenate([[0], np.cumsum([at[-1] for _, at in parts])])
        at = np.concatenate([*(x[:-1] + b for (_, x), b in zip(parts, base, strict=False)), base[-1:]]).astype(np.int64)
    else:
        n = np.array([len(t) for t in texts], dtype=np.int64)
        joined, at = b"".join(texts), None
    first = np.concatenate([[0], np.cumsum(n)])
    none = np.zeros(0, np.int64)
    windows = int(first[-1]) - unit.window + 1
    if windows < 1:
        return [(none, none, none)] * len(texts)
    # a window must not cross from one text to the next
    cross = np.zeros(windows + 1, dtype=np.int64)
    inner = first[1:-1]
    np.add.at(cross, np.clip(inner - unit.window + 1, 0, windows), 1)
    np.add.at(cross, np.clip(inner, 0, windows), -1)
    whole = np.flatnonzero(np.cumsum(cross[:windows]) == 0)
    if not len(whole):
        return [(none, none, none)] * len(texts)
    g = gram_hashes(unit_hashes(np.frombuffer(joined, np.uint8), at), unit.k) if unit.words else byte_grams(joined, unit.k)
    ranked = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    least = (sliding(ranked, unit.window - unit.k + 1, np.minimum)[whole] & _LOW).astype(np.int64)
    cut = np.flatnonzero((np.diff(least) != 0) | (np.diff(whole) != 1)) + 1
    start, stop = whole[np.concatenate([[0], cut])], whole[np.concatenate([cut - 1, [len(whole) - 1]])]
    chosen = least[np.concatenate([[0], cut])]
    text = np.searchsorted(first, chosen, "right") - 1
    a, b = (at[start], at[stop + unit.window] - 1) if unit.words else (start, stop + unit.window)
    left = chosen - start
    digest = xxhash.xxh3_64_intdigest
    digests = np.array([digest(joined[x:y], z) for x, y, z in zip(a.tolist(), b.tolist(), left.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
    loc = ((chosen - first[text]) << 16) | (left << 8) | (stop - start)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    key = g[chosen].view(np.int64)
    return [(key[x:y], digests[x:y], loc[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def before(loc):
    """Units of the stretch before its anchor."""
    return (loc >> 8) & 255


def base(loc):
    """15 bits of the text, and where the stretch starts in it."""
    return (loc >> 16) - before(loc)


def named(docs: DataFrame, key: str, text: str) -> list[Column]:
    """k, m and q: which text a row has."""
    whole = docs[text].cast("binary")
    return [row_key(docs, key).alias("k"), F.xxhash64(whole).alias("m"), F.shiftrightunsigned(F.xxhash64(F.lit("text"), whole), 49).alias("q")]


TEXT = ["k", "m", "q"]


def of_text() -> Column:
    return F.shiftrightunsigned("loc", 48)


def position() -> Column:
    return F.shiftright("loc", 16).bitwiseAND(F.lit(_POSITION))


def located(docs: DataFrame, key: str, text: str, unit: Unit) -> DataFrame:
    """a (anchor), s (surroundings), k, m, loc of every anchor."""

    def run(slices):
        for texts in slices:
            found = anchors([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts], unit)
            yield [lists([[f[i] for f in found] for i in range(3)], ["a", "s", "loc"])]

    out = map_texts(docs.select(*named(docs, key, text), docs[text].alias("text")), TEXT, F.col("text"), run, "x array<struct<a:bigint,s:bigint,loc:bigint>>", slice_bytes=300_000)
    out = out.select("row.*", F.explode("x").alias("x"))
    return out.select("x.a", "x.s", "k", "m", F.shiftleft("q", 48).bitwiseOR(F.col("x.loc")).alias("loc"))


def lists(columns: list[list[np.ndarray]], names: list[str]) -> pa.Array:
    """A list of structs for each text."""
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in columns[0]])]).astype(np.int32)
    flat = [pa.array(np.concatenate(c).astype(np.int64)) if c else pa.array([], pa.int64()) for c in columns]
    return pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays(flat, names=names))


def row_key(docs: DataFrame, key: str):
    return F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63)))


SPANS = "array<struct<start:int,end:int>>"


def repeated_spans(docs: DataFrame, *, key: str, text: str, unit: Unit, judge, keep_first: bool, shard_units: int = 150_000, group_limit: int | None = None) -> DataFrame:
    """k, m, q, spans: for each text that has any, its units covered by windows that stand elsewhere (keep_first: that stand earlier, by key, hash of the text and position).

    A shard has about shard_units units of text; an anchor's surroundings share one, unless they are more than it holds.
    """
    group_limit = group_limit or max(2, int(shard_units / (1.5 * unit.window)))
    every = stored(located(docs, key, text, unit))  # texts are hashed once
    often = stored(every.groupBy("a").count().filter("count > 1").select("a"))  # a table of its own, so that the join can split an anchor that a third of all texts have
    found = stored(every.join(often, "a").select("a", "s", "k", "m", "loc"))
    forget(every)
    kinds = found.groupBy("a", "s").agg(F.count("*").alias("n"), F.min(F.struct("k", "m", "loc")).alias("first"))
    of_anchor = kinds.groupBy("a").agg(F.count("*").alias("kinds"))
    kinds = stored(kinds.join(of_anchor, "a").select("a", "s", "n", "first.*", "kinds"))
    several = kinds.filter("kinds > 1")
    size = several.filter(F.col("kinds") <= group_limit).count()
    shards = max(1, math.ceil(size * 1.5 * unit.window / shard_units))
    pieces = stored(surroundings(docs, several, key, text, unit))
    small = pieces.filter(F.col("kinds") <= group_limit).withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))

    def judged(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k", "ascending"), ("m", "ascending"), ("loc", "ascending")])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        spans = [[{"start": x, "end": y} for x, y in f] for f in judge(t, unit)]
        return t.select(["k", "m", "loc"]).append_column("spans", pa.array(spans, kind))

    own = small.groupBy("shard").applyInArrow(judged, f"k bigint, m bigint, loc bigint, spans {SPANS}")
    if not several.filter(F.col("kinds") > group_limit).isEmpty():
        own = own.unionByName(by_digest(pieces.filter(F.col("kinds") > group_limit), unit, keep_first))
    own = stored(own.filter(F.size("spans") > 0).select("k", "m", "loc", F.explode("spans").alias("x")))
    ahead, more = F.shiftright("loc", 8).bitwiseAND(F.lit(255)), F.col("loc").bitwiseAND(F.lit(255))
    whole = F.struct((-ahead).cast("int").alias("start"), (more - ahead + unit.window).cast("int").alias("end")).alias("x")
    # of equal surroundings every copy repeats the first, and the first the others
    copied = kinds.filter("n > 1")
    copies = found.join(copied.select("a", "s", F.col("k").alias("k1"), F.col("m").alias("m1"), F.col("loc").alias("loc1")), ["a", "s"])
    copies = copies.filter((F.col("k") != F.col("k1")) | (F.col("m") != F.col("m1")) | (F.col("loc") != F.col("loc1"))).select("k", "m", "loc", whole)
    own = own.unionByName(copies)
    if not keep_first:
        own = own.unionByName(copied.select("k", "m", "loc", whole))
    spans = own.select("k", "m", of_text().alias("q"), F.struct((position() + F.col("x.start")).cast("int").alias("start"), (position() + F.col("x.end")).cast("int").alias("end")).alias("x"))
    return spans.groupBy(*TEXT).agg(F.collect_list("x").alias("spans"))


def surroundings(docs: DataFrame, kinds: DataFrame, key: str, text: str, unit: Unit) -> DataFrame:
    """a, k, m, loc, kinds and piece (the bytes of the stretch), cut from the text that holds the first copy. Rows that repeat a text come together in the join, and only the first of them is cut."""
    of = kinds.groupBy("k", "m", of_text().alias("q")).agg(F.collect_list(F.struct("a", "loc", "kinds")).alias("x"))
    texts = docs.select(*named(docs, key, text), docs[text].cast("binary").alias("text")).filter(F.col("text").isNotNull())
    joined = texts.join(of, TEXT)
    names = ["a", "k", "m", "loc", "kinds", "piece"]

    def run(batches):
        last = None
        for b in batches:
            texts, lists_ = b.column(2), b.column(3)
            a, loc, kinds_ = (np.asarray(f) for f in lists_.flatten().flatten())
            cut = np.concatenate([[0], np.cumsum(np.asarray(lists_.value_lengths()))])
            rows: list[np.ndarray] = []
            pieces, size = [], 0

            def batch(b=b, a=a, loc=loc, kinds_=kinds_, cut=cut):
                at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                of = np.searchsorted(cut, at, "right") - 1
                return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(np.asarray(b.column(0))[of]), pa.array(np.asarray(b.column(1))[of]), pa.array(loc[at]), pa.array(kinds_[at]), pa.array(pieces, pa.binary())], names=names)

            for i, this in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                own = loc[cut[i] : cut[i + 1]]
                if last == (this := (*this, int(own[0]) >> 48)):
                    continue
                last = this
                start = base(own) & _POSITION
                end = start + (own & 255) + unit.window
                if unit.words:
                    flat, at = unit.split(texts[i].as_buffer().to_pybytes())
                    start, end = at[start], at[end] - 1
                else:
                    flat = texts[i].as_buffer().to_pybytes()
                pieces += [flat[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                rows.append(np.arange(cut[i], cut[i + 1]))
                size += int((end - start).sum())
                if size > 16_000_000:
                    yield batch()
                    rows, pieces, size = [], [], 0
            yield batch()

    return joined.select("k", "m", "text", "x").mapInArrow(run, "a bigint, k bigint, m bigint, loc bigint, kinds bigint, piece binary")


def classes_of(unit: Unit, n: int) -> list[tuple[int, int]]:
    """The windows around an anchor in n classes, by the units they have before it: least and most."""
    free = unit.window - unit.k
    return [(j * (free + 1) // n, (j + 1) * (free + 1) // n - 1) for j in range(n)]


def cores(a: int, left: int, flat: bytes, at, unit: Unit, bounds: list[tuple[int, int]]):
    """(class, digest) of what all windows of a class share, for the classes that have windows in this piece. Where no other piece has a class's core, none has its windows."""
    n = len(at) - 1
    for j, (low, high) in enumerate(bounds):
        end = left + unit.window - high
        if low <= left and end <= n:
            yield j, xxhash.xxh3_64_intdigest(flat[at[left - low] : at[end] - unit.words], (a + j) & ((1 << 64) - 1))


def by_digest(pieces: DataFrame, unit: Unit, keep_first: bool, classes: int = 12) -> DataFrame:
    """Verdicts (k, loc, one span) for anchors with more surroundings than a shard takes, by counts of digests, whichever task they stand in.

    A class of windows whose core stands in one piece alone is not repeated. Of pieces that agree in all of
    a class's windows (its hull) the first stands for the others, whose windows are all repeats of its. Only
    windows of first pieces are counted one by one. All windows around an anchor overlap, so each piece has one span.
    """
    bounds = classes_of(unit, classes)
    place = ["k", "m", "loc"]

    def emit(names, rows_of):
        def run(batches):
            for b in batches:
                c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                out: list[list] = [[] for _ in names]
                for i in range(b.num_rows):
                    flat, at = unit.split(c["piece"][i])
                    for row in rows_of(c, i, c["a"][i], before(c["loc"][i]), flat, at):
                        for o, v in zip(out, (c["a"][i], c["k"][i], c["m"][i], c["loc"][i], *row), strict=True):
                            o.append(v)
                    if len(out[0]) > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)
                        out = [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)

        return run, ", ".join(f"{n} bigint" for n in names)

    digest = xxhash.xxh3_64_intdigest

    def core_rows(c, i, a, left, flat, at):
        for j, d in cores(a, left, flat, at, unit, bounds):
            start, end = max(0, left - bounds[j][1]), min(len(at) - 1, left + unit.window - bounds[j][0])
            yield j, d - (1 << 63), digest(flat[at[start] : at[end] - unit.words], left - start) - (1 << 63)

    def window_rows(c, i, a, left, flat, at):
        for j in c["classes"][i]:
            for s in range(max(0, left - bounds[j][1]), min(left - bounds[j][0], len(at) - 1 - unit.window) + 1):
                yield s - left, digest(flat[at[s] : at[s + unit.window] - unit.words]) - (1 << 63)

    core = stored(pieces.mapInArrow(*emit(["a", *place, "j", "c", "h"], core_rows)))
    often = stored(core.groupBy("a", "j", "c").count().filter("count > 1").drop("count"))  # a table of its own, so that the join can split a core that very many pieces have
    repeated = stored(core.join(often, ["a", "j", "c"]).select("a", *place, "j", "h"))
    forget(core)
    hulls = stored(repeated.groupBy("a", "j", "h").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")))
    of_piece = hulls.groupBy("first.k", "first.m", "first.loc").agg(F.collect_set("j").alias("classes"))
    windows = pieces.join(of_piece, place).mapInArrow(*emit(["a", *place, "offset", "d"], window_rows))
    windows = stored(windows.withColumn("where", F.struct("k", "m", of_text().alias("q"), (position() + F.col("offset")).alias("at"))))
    seen = stored(windows.groupBy("a", "d").agg(F.min("where").alias("least"), F.max("where").alias("most")).filter("least <> most"))
    again = windows.join(seen, ["a", "d"])
    if keep_first:
        again = again.filter(F.col("where") != F.col("least"))
    low, high = (F.element_at(F.array(*[F.lit(b[i]) for b in bounds]), F.col("j").cast("int") + 1) for i in (0, 1))
    same = repeated.join(hulls.filter("n > 1").select("a", "j", "h", "first"), ["a", "j", "h"])
    if keep_first:
        same = same.filter(F.struct(*place) != F.col("first"))
    ahead, more = F.shiftright("loc", 8).bitwiseAND(F.lit(255)), F.col("loc").bitwiseAND(F.lit(255))
    spans = again.select(*place, F.col("offset").cast("int").alias("start"), (F.col("offset") + unit.window).cast("int").alias("end"))
    spans = spans.unionByName(same.select(*place, (-F.least(high, ahead)).cast("int").alias("start"), (unit.window - F.greatest(low, ahead - more)).cast("int").alias("end")))
    return spans.groupBy(*place).agg(F.array(F.struct(F.min("start").alias("start"), F.max("end").alias("end"))).alias("spans"))


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def united(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The maximal runs that spans (not empty) cover, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return np.stack([start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]], axis=1).astype(np.int64)


def without(docs: DataFrame, spans: DataFrame, *, keep: list[str], key: str, text: str, unit: Unit, full: bool = False) -> DataFrame:
    """row (struct of keep), n_units, n_removed, n_spans, kept_sha256, and with full also kept: each text without its spans.

    Kept words are joined by one space; kept bytes follow each other. Null texts count as empty.
    """
    rows = docs.select(*named(docs, key, text), F.struct(*[docs[c] for c in keep]).alias("row"), docs[text].cast("binary").alias("text"))
    joined = rows.join(spans, TEXT, "left").select("row", "text", F.col("spans").alias("x"))
    names = ["row", "n_units", "n_removed", "n_spans", "kept_sha256", *["kept"] * full]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_buffer().to_pybytes() if b.column(1)[i].is_valid else b""
                if not b.column(2)[i].is_valid:
                    words = raw.split() if unit.words else raw
                    n, removed, spans_, kept = len(words), 0, 0, b" ".join(words) if unit.words else raw
                else:
                    flat, at = unit.split(raw) if unit.words else (raw, None)
                    n = len(at) - 1 if unit.words else len(raw)
                    gone = united(*(np.clip(np.asarray(x), 0, n) for x in b.column(2)[i].values.flatten()))
                    removed, spans_ = int((gone[:, 1] - gone[:, 0]).sum()), len(gone)
                    left = np.stack([np.append(0, gone[:, 1]), np.append(gone[:, 0], n)], axis=1)
                    left = left[left[:, 0] < left[:, 1]]
                    if unit.words:
                        left = np.stack([at[left[:, 0]], at[left[:, 1]] - 1], axis=1)
                    kept = (b" " if unit.words else b"").join(flat[a:z] for a, z in left.tolist())
                for o, v in zip(out, (n, removed, spans_, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    o.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, t) for o, t in zip(out, types, strict=False)]], names=names)

    schema = joined.select("row").schema.add("n_units", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return joined.mapInArrow(run, schema.add("kept", "binary") if full else schema)
