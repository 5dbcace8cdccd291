"""Benchmark decontamination by suffix arrays over shards of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import as_bytes, filter_by_text, named, staged

#: A-Z to lower case, every other ASCII character that is no letter or digit to a space.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


def _packed(ids: np.ndarray, starts: np.ndarray, length: int, bits: int) -> list[np.ndarray]:
    """The first ``length`` word numbers from each start, as whole numbers in word order."""
    each = max(1, 63 // bits)
    columns = []
    for first in range(0, length, each):
        key = np.zeros(len(starts), np.int64)
        for j in range(first, min(first + each, length)):
            key = (key << bits) | ids[starts + j]
        columns.append(key)
    return columns


@dataclass
class TestSuffixes:
    """The suffixes of a block of test items that begin a window, cut at the window's end.

    ``suffixes[length]`` has the item and the word offset of each; ``sorted_keys`` their packed words.
    """

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    suffixes: dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = field(default_factory=dict)
    bits: int = 1

    @classmethod
    def build(cls, rows: list[tuple[str, bytes]], window: int) -> TestSuffixes:
        made, texts = cls(), []
        for item, text in rows:
            words = words_of(text)
            if words:
                made.items.append(item)
                texts.append([made.vocabulary.setdefault(w, len(made.vocabulary) + 1) for w in words])
        made.bits = max(1, (len(made.vocabulary) + 1).bit_length())
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        at = 0
        for number, ids in enumerate(texts):
            length = min(window, len(ids))
            by_length.setdefault(length, []).extend((number, j, at + j) for j in range(len(ids) - length + 1))
            at += len(ids)
        ids = np.array([x for t in texts for x in t], np.int64)
        for length, found in by_length.items():
            number, offset, start = np.array(found, np.int64).T
            made.suffixes[length] = number, offset, _packed(ids, start, length, made.bits)
        return made


def _ranked(columns: list[np.ndarray], queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One whole number for each row of ``columns``, in their order, and that of equal ``queries`` or -1."""
    key, wanted = columns[0], queries[0]
    for column, query in zip(columns[1:], queries[1:], strict=True):
        known, key = np.unique(key, return_inverse=True)
        wanted = _place(known, wanted)
        known, low = np.unique(column, return_inverse=True)
        below = _place(known, query)
        wanted = np.where((wanted < 0) | (below < 0), -1, (wanted << 31) | below)
        key = (key.astype(np.int64) << 31) | low
    return key, wanted


def _place(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in the sorted ``known`` by binary search; -1 if it doesn't."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1).astype(np.int64)


class SuffixArray:
    """The sorted suffixes of a shard of documents, over the words that the test items know.

    A suffix is kept if its next ``length`` words stand in one document and are all known: no other can
    match a test suffix of that length.
    """

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
        self.run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(ids))

    def search(self, length: int, bits: int, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in the shard, number of the query) of every occurrence."""
        starts = np.flatnonzero(self.run >= length)
        keys, wanted = _ranked(_packed(self.ids, starts, length, bits), queries)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = starts[order], keys[order]
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        count = np.where(wanted < 0, 0, high - low)
        query = np.repeat(np.arange(len(wanted)), count)
        inside = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        return suffixes[low[query] + inside], query


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    table, back = np.unique(np.stack(columns), axis=1, return_inverse=True)
    return list(table), back.reshape(-1)


@dataclass
class ShardMatches:
    """What a shard of documents shares with the test items."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[set[str]]
    longest: np.ndarray
    longest_at: np.ndarray
    hit: list[bytes]  # a bit for each word


def match_shard(texts: list[bytes], blocks: list, window: int, details: bool = True, earlier: pa.RecordBatch | None = None) -> ShardMatches:
    """Search every test suffix of every block in the suffix array of these texts.

    ``earlier`` holds what blocks searched before have found: hit, items, longest, longest_at.
    """
    split = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    begins = np.cumsum(n_words + 1) - (n_words + 1)  # a stop follows each document
    size = int((n_words + 1).sum())
    hit = np.zeros(size, bool)
    items: list[set[str]] = [set() for _ in texts]
    longest, longest_at = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
    if earlier is not None:
        found, names, n, at = (c.to_pylist() for c in earlier.columns)
        for bits, words, begin in zip(found, n_words.tolist(), begins.tolist(), strict=True):
            hit[begin : begin + words] = np.unpackbits(np.frombuffer(bits, "u1"), count=words)
        items = [set(x) for x in names]
        longest, longest_at = np.array(n, np.int64), np.array(at, np.int64)
    for block in blocks:
        tests = TestSuffixes(*block.value) if isinstance(block, Broadcast) else block
        ids = np.zeros(size, np.int64)
        know = tests.vocabulary.get
        for words, at in zip(split, begins.tolist(), strict=True):
            ids[at : at + len(words)] = [know(w, 0) for w in words]
        array = SuffixArray(ids)
        for length, (item, offset, keys) in tests.suffixes.items():
            # equal windows of several items are searched once
            distinct, back = _distinct(keys)
            place, query = array.search(length, tests.bits, distinct)
            if not len(place):
                continue
            edge = np.zeros(size + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + length, -1)
            hit |= np.cumsum(edge)[:-1] > 0
            doc = np.searchsorted(begins, place, "right") - 1
            by_window = np.argsort(back, kind="stable")
            lows = np.searchsorted(back[by_window], np.arange(len(distinct[0]) + 1))
            for d, q in set(zip(doc.tolist(), query.tolist(), strict=True)):
                owners = item[by_window[lows[q] : lows[q + 1]]]
                items[d].update(tests.items[i] for i in owners.tolist())
            if details:
                _longest(place, query, length, doc, begins, item, offset, by_window, lows, longest, longest_at)
    n_hit = np.add.reduceat(hit.astype(np.int64), begins) if len(texts) else n_words
    bits = [np.packbits(hit[a : a + n]).tobytes() for a, n in zip(begins.tolist(), n_words.tolist(), strict=True)]
    return ShardMatches(n_words, n_hit, items, longest, longest_at, bits)


def _longest(place, query, length, doc, begins, item, offset, by_window, lows, longest, longest_at) -> None:
    """Windows of one item that follow each other in a document are one verbatim match."""
    count = lows[query + 1] - lows[query]
    at = np.repeat(np.arange(len(place)), count)
    which = by_window[np.repeat(lows[query], count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]
    order = np.lexsort((place[at], place[at] - offset[which], item[which]))
    where, shift, owner = place[at][order], (place[at] - offset[which])[order], item[which][order]
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(where) != 1) | (np.diff(shift) != 0) | (np.diff(owner) != 0)
    starts = np.flatnonzero(new)
    words = np.diff(np.append(starts, len(where))) + length - 1
    docs = doc[at][order][starts]
    for d, n, p in zip(docs.tolist(), words.tolist(), where[starts].tolist(), strict=True):
        if n > longest[d]:
            longest[d], longest_at[d] = n, p - begins[d]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """The test suffixes in blocks of about ``block_chars`` characters, and whether the block is the last.

    One block is held at a time: what searches a block must have been written before the next is asked for.
    """
    rows = benchmark.select(F.coalesce(named(item).cast("string"), F.lit("null")).alias("item"), named(text).alias("text"))
    rows = rows.where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = total // block_chars + 1
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()
        tests = TestSuffixes.build([(r["item"], r["text"].encode()) for r in part], window)
        block = benchmark.sparkSession.sparkContext.broadcast((tests.vocabulary, tests.items, tests.suffixes, tests.bits))
        del part, tests
        yield block, k == count - 1
        if k < count - 1:
            block.destroy()


def matches(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", bench_text: str = "text",
    keep: list[str], window: int = 10, block_chars: int = 16_000_000, shard_docs: int = 2000,
) -> DataFrame:
    """``keep`` and what each document shares with the test items, in one scan of the documents per block of items.

    A window is ``window`` words of an item in a row, or the whole of a shorter one. Added: ``n_words``,
    ``n_hit`` (words inside a window), ``items`` (array of the ids of items with a window here, sorted as
    strings), ``longest`` and ``longest_at`` (words of the longest verbatim match, and its first word; 0 and
    -1 if none). Null texts have no words and match nothing; a null item id is the string ``null``; items of
    equal id are one. Without test items nothing matches; an empty table gives an empty one; repeated rows get equal
    results; kept columns named like new ones are replaced. Test items go out in blocks of bounded size, one at a time: before the next, the documents are
    written with what was found so far.
    """
    long = T.LongType()
    added = [
        T.StructField("n_words", long), T.StructField("n_hit", long), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", long), T.StructField("longest_at", long),
    ]
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in {x.name for x in added}]
    plain = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)]
    state = [T.StructField("text", T.StringType()), T.StructField("hit", T.BinaryType()), *added[2:]]
    frame = docs.select(*(named(f.name).alias(x.name) for f, x in zip(kept, plain, strict=True)), named(text).cast("string").alias("text"))
    for block, last in _blocks(benchmark, item, bench_text, window, block_chars):
        frame = _searched(frame, len(kept), block, window, shard_docs, T.StructType([*plain, *(added if last else state)]), last)
        if not last:
            frame = staged(frame, "matches")
    return frame.toDF(*(f.name for f in [*kept, *added]))


def _searched(frame: DataFrame, kept: int, block: Broadcast, window: int, shard_docs: int, schema: T.StructType, last: bool) -> DataFrame:
    """``frame`` (the columns kept, the text, and from the second block on what was found before) after one more block."""
    names = frame.columns[kept + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, shard_docs):
                part = batch.slice(i, shard_docs)
                earlier = pa.RecordBatch.from_arrays(part.columns[kept + 1 :], names=names) if names else None
                m = match_shard(as_bytes(part.column(kept)), [block], window, earlier=earlier)
                found = [pa.array([sorted(x) for x in m.items], pa.list_(pa.string())), pa.array(m.longest), pa.array(m.longest_at)]
                mine = [pa.array(m.n_words), pa.array(m.n_hit)] if last else [part.column(kept), pa.array(m.hit, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *mine, *found], names=schema.names)

    return frame.mapInArrow(run, schema)


def clean(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", bench_text: str = "text",
    window: int = 10, block_chars: int = 16_000_000, shard_docs: int = 2000,
) -> DataFrame:
    """``docs`` without the documents that hold a window of a test item; all columns as they are, whatever their names.

    Null and empty texts stay, and so does everything if there are no test items; an empty table gives an empty one."""
    def make(block: Broadcast):
        def mask(texts: pa.Array) -> pa.Array:
            hits = [
                match_shard(as_bytes(texts[i : i + shard_docs]), [block], window, details=False).n_hit
                for i in range(0, len(texts), shard_docs)
            ]
            return pa.array(np.concatenate(hits or [np.empty(0, np.int64)]) == 0)

        return mask

    for block, last in _blocks(benchmark, item, bench_text, window, block_chars):
        docs = filter_by_text(docs, text, partial(make, block))
        if not last:
            docs = staged(docs, "clean")
    return docs
