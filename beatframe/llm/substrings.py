"""Substring dedup: suffix automata of reference shards give documents' matching statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from beatframe.llm.common import table
from beatframe.llm.repeats import Unit, base, before, repeated_spans, without


class Automaton:
    """Suffix automaton of several word sequences; each state knows where its strings first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def add(self, words: list, places: list) -> None:
        nexts, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w, place in zip(words, places, strict=True):
            if (q := nexts[last].get(w)) is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            first.append(place)
            link.append(0)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.first.append(self.first[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def matches(self, words: list, least: int):
        """For each word the place where the last `least` words up to it first ended in the reference, or None."""
        nexts, link, length = self.next, self.link, self.length
        v = n = 0
        for w in words:
            while v and w not in nexts[v]:
                v = link[v]
                n = length[v]
            if (q := nexts[v].get(w)) is not None:
                v, n = q, n + 1
            if n < least:
                yield None
                continue
            u = v
            while length[link[u]] >= least:
                u = link[u]
            yield self.first[u]


def stream(t: pa.Table, unit: Unit) -> list[list[tuple[int, int]]]:
    """Spans of each stretch, in units from its anchor, whose windows stand earlier in this shard.

    The shard's automaton starts empty. Documents come in order, each with its stretches; a stretch is streamed
    through the automaton, whose matching statistics of a window or more give the maximal spans that go,
    and what is new of it joins the automaton.
    """
    keys, marks, locs, pieces = (t[c].to_pylist() for c in ("k", "m", "loc", "piece"))
    out: list[list[tuple[int, int]]] = []
    automaton, window = Automaton(), unit.window
    for k, m, loc, piece in zip(keys, marks, locs, pieces, strict=True):
        words, left, begin = piece.split(), before(loc), base(loc)
        places = [(k, m, begin + i) for i in range(len(words))]
        gone: list[list[int]] = []
        new: list[list[int]] = []
        for i, first in enumerate(automaton.matches(words, window)):
            if i + 1 < window:
                continue
            into = new if first is None else gone if first != places[i] else None
            if into is not None:
                if into and into[-1][1] >= i + 1 - window:
                    into[-1][1] = i + 1
                else:
                    into.append([i + 1 - window, i + 1])
        for x, y in new:
            automaton.add(words[x:y], places[x:y])
        out.append([(x - left, y - left) for x, y in gone])
    return out


def dedup_substrings(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text", window: int = 20, k: int = 6, full: bool = False) -> DataFrame:
    """row (struct of keep), n_units, n_removed, n_spans, kept_sha256 (and kept with full): docs without the words of every window of `window` words that also starts earlier.

    Earlier: a smaller key, or the same text further ahead. Documents and reference shards meet by anchors (see
    repeats), as automata of all texts can't be broadcast; a shard streams the stretches of the documents that have its anchors.

    Null texts have no words. Null keys come before all others. Texts that share a key are ordered by a
    hash of the text; rows that repeat key and text are one document, returned as often as they come. Texts of
    any length are read whole. Empty table: no rows.
    """
    unit = Unit(words=True, window=window, k=k)
    spans = repeated_spans(docs, key=key, text=text, unit=unit, judge=stream, keep_first=True)
    return without(docs, spans, keep=keep, key=key, text=text, unit=unit, full=full)


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    """dedup_substrings over all documents; see there."""
    out = dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.selectExpr("row.doc_id", "n_units as n_words", "n_removed", "kept_sha256")
