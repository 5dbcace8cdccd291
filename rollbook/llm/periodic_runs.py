"""Periodic runs of words, found on a Re-Pair grammar of each batch of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import Scorer, as_bytes, per_text

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
GRAM = 6  # a run of 12 words and more has at least so many words in a row that come back one period later
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _repeating(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words inside a stretch of GRAM words that their document holds twice: every word of every run is one."""
    keep = np.zeros(len(ids), bool)
    n = len(ids) - GRAM + 1
    if n <= 0:
        return keep
    key = _mixed(doc[:n] + 1)
    for j in range(GRAM):
        key = _mixed(key + ids[j : j + n].astype(np.uint64) * np.uint64(2 * j + 3))
    inside = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + GRAM, -1)
    return np.cumsum(edge)[:-1] > 0


@dataclass
class Grammar:
    """Nonterminals of a sequence: where one of them lies, how long its left part and all of it are, and all places."""

    place: np.ndarray
    left: np.ndarray
    length: np.ndarray
    owners: np.ndarray  # nonterminal of each derivation position, ascending
    places: np.ndarray

    @classmethod
    def repair(cls, sequence: np.ndarray) -> Grammar:
        """Re-Pair: the most frequent pairs become nonterminals until no pair is left twice. Negative symbols end a
        stretch and are in no pair. In one round every pair is replaced wherever no more frequent one overlaps it. What
        stays of a stretch is paired neighbour with neighbour until one nonterminal is left.
        """
        symbols, at = sequence.astype(np.int64), np.arange(len(sequence))
        size = np.ones(len(sequence), np.int64)
        fresh = int(symbols.max(initial=0)) + 1
        made: list[tuple[np.ndarray, ...]] = []
        frequent, count = True, 0
        while len(symbols) > 1:
            whole = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
            if not whole.any():
                break
            chosen, owner = cls._frequent(symbols, whole) if frequent else cls._neighbours(symbols, whole)
            if not len(chosen):
                frequent = False
                continue
            rules, first, owner = np.unique(owner, return_index=True, return_inverse=True)
            head = chosen[first]
            made.append((at[head], size[head], size[head] + size[head + 1], owner.reshape(-1) + count, at[chosen]))
            count += len(rules)
            symbols[chosen] = fresh + owner.reshape(-1)
            size[chosen] += size[chosen + 1]
            fresh += len(rules)
            stay = np.ones(len(symbols), bool)
            stay[chosen + 1] = False
            symbols, at, size = symbols[stay], at[stay], size[stay]
        if not made:
            return cls(*(np.zeros(0, np.int64) for _ in range(5)))
        place, left, length, owners, places = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(owners, kind="stable")
        return cls(place, left, length, owners[order], places[order])

    @staticmethod
    def _frequent(symbols: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair that occurs twice and that no more frequent one overlaps begins, and the number of the pair."""
        key = np.where(whole, symbols[:-1] << 32 | symbols[1:], -1)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        able = whole & ((np.arange(len(key)) - begin) % 2 == 0)  # of x x x only the first pair counts
        _, number, n = np.unique(key[able], return_inverse=True, return_counts=True)
        rank = np.zeros(len(key), np.uint64)
        times = n[number].astype(np.uint64)
        rank[able] = np.where(times > 1, times << np.uint64(32) | _mixed(key[able]) >> np.uint64(32), 0)
        before, after = np.append(np.uint64(0), rank[:-1]), np.append(rank[1:], np.uint64(0))
        chosen = np.flatnonzero((rank > before) & (rank >= after))
        pair, owner, n = np.unique(key[chosen], return_inverse=True, return_counts=True)
        twice = n[owner] > 1
        return chosen[twice], owner[twice]

    @staticmethod
    def _neighbours(symbols: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = np.maximum.accumulate(np.where(symbols < 0, np.arange(len(symbols)), -1))
        chosen = np.flatnonzero(whole & ((np.arange(len(whole)) - stop[:-1]) % 2 == 1))
        return chosen, np.arange(len(chosen))


class _Extensions:
    """How far two places of a sequence agree, by exact names of its stretches of 1, 2, 4, ... symbols."""

    def __init__(self, sequence: np.ndarray, longest: int):
        self.names = [np.unique(sequence, return_inverse=True)[1].reshape(-1).astype(np.int64)]
        step = 1
        while 2 * step <= longest:
            last = self.names[-1]
            pairs = last[:-step] << 32 | last[step:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].reshape(-1).astype(np.int64))
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            for _ in range(2 if level == len(self.names) - 1 else 1):
                top = len(names) - 1
                same = (np.maximum(i, j) <= top) & (names[np.minimum(i, top)] == names[np.minimum(j, top)])
                grow = np.where(same, 1 << level, 0)
                i, j, out = i + grow, j + grow, out + grow
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Agreeing symbols that end before ``i`` and ``j``."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, step = self.names[level], 1 << level
            for _ in range(2 if level == len(self.names) - 1 else 1):
                a, b = np.maximum(i - step, 0), np.maximum(j - step, 0)
                top = len(names) - 1
                same = (np.minimum(i, j) >= step) & (names[np.minimum(a, top)] == names[np.minimum(b, top)])
                grow = np.where(same, step, 0)
                i, j, out = i - grow, j - grow, out + grow
        return out


def _crossing(sequence: np.ndarray, grammar: Grammar, least: int, longest: int) -> tuple[np.ndarray, ...]:
    """Nonterminal, start, end and period of every run that crosses the boundary of a nonterminal, inside it."""
    nodes = np.flatnonzero(grammar.length >= least)
    if not len(nodes):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    low, middle = grammar.place[nodes], grammar.place[nodes] + grammar.left[nodes]
    high = low + grammar.length[nodes]
    found: list[tuple[np.ndarray, ...]] = []

    def keep(which: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray | int) -> None:
        start, end = np.maximum(start, low[which]), np.minimum(end, high[which])
        run = (end - start >= np.maximum(least, 2 * period)) & (start < middle[which]) & (end > middle[which])
        found.append((which[run], start[run], end[run], np.broadcast_to(period, len(which))[run]))

    # short periods: stretches of places that agree with the place one period on
    every = np.arange(len(nodes))
    for period in range(1, min(2 * GRAM, len(sequence))):
        agree = sequence[:-period] == sequence[period:]
        places = np.arange(len(agree))
        stop = np.minimum.accumulate(np.where(agree, len(agree), places)[::-1])[::-1]
        last = np.maximum.accumulate(np.where(agree, -1, places))
        for inside in (middle - 1, middle - period):
            which = every[(inside >= 0) & (inside < len(agree))]
            which = which[agree[inside[which]]]
            keep(which, last[inside[which]] + 1, stop[inside[which]] + period, period)

    # longer ones: the words before or behind the boundary come back at that distance
    extend = _Extensions(sequence, longest)
    two, four = extend.names[1], extend.names[2]
    n = len(sequence) - GRAM + 1
    gram = np.unique(four[:n] << 32 | two[4 : 4 + n], return_inverse=True)[1].reshape(-1).astype(np.int64)
    keys = gram * (len(sequence) + 1) + np.arange(n)
    order = np.argsort(keys)
    keys = keys[order]
    for anchor in (middle - GRAM, middle):
        which = every[(anchor >= low) & (anchor + GRAM <= high) & (high - low >= 4 * GRAM)]
        base = gram[anchor[which]] * (len(sequence) + 1)
        first = np.searchsorted(keys, base + low[which])
        count = np.searchsorted(keys, base + high[which] - GRAM, "right") - first
        ends = np.cumsum(count)
        cuts = [0, *np.searchsorted(ends, np.arange(1 << 19, int(count.sum()), 1 << 19)).tolist(), len(which)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            node = np.repeat(which[a:b], count[a:b])
            offset = np.arange(len(node)) - np.repeat(ends[a:b] - count[a:b] - (ends[a - 1] if a else 0), count[a:b])
            period = np.abs(order[np.repeat(first[a:b], count[a:b]) + offset] - anchor[node])
            good = (period >= 2 * GRAM) & (2 * period <= (high - low)[node])
            pairs = np.unique(node[good] << 32 | period[good])
            node, period = pairs >> 32, pairs & 0xFFFFFFFF
            for inside in (middle[node] - 1, middle[node] - period):
                ok = (inside >= low[node]) & (inside + period < high[node])
                i, p, w = inside[ok], period[ok], node[ok]
                keep(w, i - extend.backward(i, i + p), i + p + extend.forward(i, i + p), p)
    which, start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start, which))
    which, start, end, period = which[order], start[order], end[order], period[order]
    new = np.ones(len(which), bool)  # the same stretch with a multiple of its period is the same run
    new[1:] = (np.diff(which) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0)
    return nodes[which[new]], start[new], end[new], period[new]


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every maximal run of at least ``least`` words and two periods, by start, then
    period. ``ids`` are the words of documents one behind the other, ``doc`` their ascending document numbers.
    """
    if least < 2 * GRAM:
        raise ValueError(f"runs are found from {2 * GRAM} words on")
    keep = _repeating(ids, doc)
    where = np.flatnonzero(keep)
    none = (np.zeros(0, np.int64),) * 3
    if not len(where):
        return none
    # stretches one behind the other, with a symbol of its own behind each
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(where) != 1) | (np.diff(doc[where]) != 0)
    stretch = np.cumsum(new) - 1
    place = np.arange(len(where)) + stretch
    length = np.bincount(stretch)
    sequence = np.full(len(where) + int(stretch[-1]) + 1, -1, np.int64)
    sequence[place] = ids[where]
    origin = np.zeros(len(sequence), np.int64)
    origin[place] = where
    stops = np.flatnonzero(sequence < 0)
    sequence[stops] = -1 - np.arange(len(stops))
    grammar = Grammar.repair(sequence)
    node, start, end, period = _crossing(sequence, grammar, least, int(length.max()))
    if not len(node):
        return none
    # each run to every derivation position of its nonterminal
    first = np.searchsorted(grammar.owners, node)
    count = np.searchsorted(grammar.owners, node, "right") - first
    run = np.repeat(np.arange(len(node)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    shift = grammar.places[first[run] + offset] - grammar.place[node[run]]
    start, end, period = start[run] + shift, end[run] + shift, period[run]
    # maximal ones: not inside another of the same period
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = period * (len(sequence) + 1) + end
    stays = np.append(True, reach[1:] > np.maximum.accumulate(reach)[:-1])
    start, end, period = start[stays], end[stays], period[stays]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    begin = origin[start]
    return begin, begin + (end - start), period


def _scored(texts: pa.Array, least: int) -> list[pa.Array]:
    words = [t.split() for t in as_bytes(texts)]
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(lengths) - lengths
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(words)), lengths)
    start, end, period = runs_of(ids, doc, least)
    owner = doc[start]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    dropped = np.cumsum(edge)[:-1] > 0
    kept: list[bytes] = [b" ".join(w) for w in words]
    for d in np.unique(owner).tolist():
        a, b = begins[d], begins[d] + lengths[d]
        kept[d] = b" ".join([w for w, out in zip(words[d], dropped[a:b].tolist(), strict=True) if not out])
    offsets = np.searchsorted(owner, np.arange(len(words) + 1))
    fields = [pa.array(start - begins[owner], pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())]
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, [f.name for f in RUN.fields]))
    return [pa.array(lengths, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]


def detect(docs: DataFrame, *, text: str = "text", keep: list[str], least: int = 12) -> DataFrame:
    """``keep``, ``n_words``, ``runs`` and ``collapsed`` of each whole text, without a shuffle.

    Words are stretches of other characters than space, tab, line feed, vertical tab, form feed and carriage return. A
    run is a maximal stretch of at least ``least`` words and two periods; ``runs`` holds start, length and smallest period
    of each by start, then period. ``collapsed`` is the words, joined by one space, without those that a run holds behind
    its first period. A null, empty or blank text has no words, no runs and an empty ``collapsed``; repeated rows get equal
    results; an empty table gives an empty one. A kept column named like a new one is replaced, others are dropped. Texts of
    one slice share a grammar; a text of any length is in one slice, which takes about 0.3 kB a word that repeats.
    """
    added = [
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
    ]

    def make() -> Scorer:
        return lambda texts: _scored(texts, least)

    return per_text(docs, text, keep, added, make)


def longest(runs) -> F.Column:
    """The run of greatest length (ties: smallest start, then period) of an array of runs; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))
