"""Phrase collocations from bidirectional FM-indexes of word ids, one for each shard of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import as_bytes, named, release, slices, staged

#: A-Z to lower case, tab to space, what ends a piece to a full stop.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if chr(c) in ".,;:!?" or 10 <= c <= 13 else c for c in range(256)
)
_STOP = b"."
#: The whole part of 1000 * f * n / (l * r), whose products may pass 64 bits.
SCORE = "(1000 * CAST(f AS DECIMAL(19,0)) * CAST(n AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in order, with a full stop wherever a piece ends."""
    return [*text.translate(_CLEAN).replace(_STOP, b" . ").split(), _STOP]


def _keys(ids: np.ndarray, depth: int) -> np.ndarray:
    """A whole number for each place, in the order of the ``depth`` words and perhaps more that begin there."""
    bits = max(1, int(ids.max()).bit_length())
    span = max(1, min(depth, 63 // bits))
    key = ids.astype(np.int64)
    for j in range(1, span):
        key = key << bits | np.roll(ids, -j)
    while span < depth:
        names = np.unique(key, return_inverse=True)[1].reshape(-1).astype(np.int64)
        key = names << 32 | np.roll(names, -span)
        span *= 2
    return key


def _transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform: the word before each suffix, suffixes sorted by their first ``depth`` words."""
    return ids[np.argsort(_keys(ids, depth)) - 1].astype("<u4")


@dataclass
class Phrases:
    """Phrases of one length: where their suffixes lie in the index and those of the reversed words in the other one."""

    words: np.ndarray  # a row of word ids for each phrase
    low: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def __getitem__(self, which: np.ndarray | slice) -> Phrases:
        return Phrases(self.words[which], self.low[which], self.back[which], self.count[which])


#: Occurrences that are looked at in one step; a phrase of more is alone in its step.
STEP = 500_000


class PhraseIndex:
    """A bidirectional FM-index: the transforms of a sequence of word ids and of its reverse. Id 0 ends a piece."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.counts = np.bincount(before)
        self.sides = []
        for words in (before, after):  # four bytes a word
            step = np.empty(len(words), np.uint32)  # from a suffix to the one that begins a word earlier
            step[np.argsort(words, kind="stable")] = np.arange(len(words), dtype=np.uint32)
            self.sides.append((words, step))

    @classmethod
    def transforms(cls, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        return _transform(ids, depth), _transform(ids[::-1], depth)

    def single(self) -> Phrases:
        """Every word; its occurrences are one interval, the same in both indexes."""
        low = np.cumsum(self.counts) - self.counts
        return Phrases(np.arange(1, len(low))[:, None], low[1:], low[1:], self.counts[1:])

    def longer(
        self, phrases: Phrases, behind: bool = False, keep: Callable[[Phrases], np.ndarray] | None = None, step: int = STEP
    ) -> Phrases:
        """Every phrase of one word more, by that word put in front or behind, and how often it occurs; with ``keep`` those
        that it marks."""
        found = [x[keep(x)] if keep else x for x in self.steps(phrases, behind, step)]
        return Phrases(*(np.concatenate([getattr(x, name) for x in found]) for name in ("words", "low", "back", "count")))

    def steps(self, phrases: Phrases, behind: bool = False, step: int = STEP) -> Iterator[Phrases]:
        """The same in parts, each from about ``step`` occurrences; one part at least."""
        ends = np.cumsum(phrases.count)
        at, before = 0, 0
        while not at or at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, before + step, "right")))
            yield self._longer(phrases[at:stop], behind)
            at, before = stop, int(ends[stop - 1]) if stop <= len(ends) else 0

    def _longer(self, phrases: Phrases, behind: bool) -> Phrases:
        """The interval of the other index is the part of the old one that goes on with that word: smaller words come before."""
        words, step = self.sides[behind]
        low, other = (phrases.back, phrases.low) if behind else (phrases.low, phrases.back)
        parent = np.repeat(np.arange(len(low)), phrases.count)
        begin = np.cumsum(phrases.count) - phrases.count
        place = low[parent] + np.arange(len(parent)) - begin[parent]
        key = parent << 32 | words[place].astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        of, word = key[first] >> 32, key[first] & 0xFFFFFFFF
        mine, its = step[place[order[first]]].astype(np.int64), other[of] + first - begin[of]
        columns = [phrases.words[of], word] if behind else [word, phrases.words[of]]
        found = Phrases(np.column_stack(columns), *((its, mine) if behind else (mine, its)), count)
        return found[word > 0]


_INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("words", T.BinaryType()),
    T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType()),
])


def build_index(docs: DataFrame, *, text: str, group: str, depth: int, shard_words: int) -> DataFrame:
    """The index of each shard: the texts of one group that a task reads in a row, up to about ``shard_words`` words."""
    rows = docs.select(F.coalesce(named(group).cast("string"), F.lit("und")).alias("lang"), named(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[str, dict[bytes, int]] = {}
        parts: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            words = known.pop(lang)
            size.pop(lang)
            transforms = PhraseIndex.transforms(np.concatenate(parts.pop(lang)), depth + 1)
            packed = [zstandard.compress(x, 1) for x in (b"\n".join(words), *(t.tobytes() for t in transforms))]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([lang]), *(pa.array([x], pa.binary()) for x in packed)], names=_INDEX.names
            )

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, stop in slices(batch.column(1)):
                for lang, body in zip(langs[at:stop], as_bytes(batch.column(1)[at:stop]), strict=True):
                    ids = known.setdefault(lang, {_STOP: 0})
                    found = tokens(body)
                    parts.setdefault(lang, []).append(np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.uint32, len(found)))
                    size[lang] = size.get(lang, 0) + len(found)
                    if size[lang] >= shard_words:
                        yield flush(lang)
        for lang in list(known):
            yield flush(lang)

    return staged(rows.mapInArrow(run, _INDEX), "phrases")


def _opened(batch: pa.RecordBatch, row: int) -> tuple[int, str, list[bytes], PhraseIndex]:
    shard, lang, words, before, after = (batch.column(i)[row].as_py() for i in range(len(_INDEX)))
    before, after = (np.frombuffer(zstandard.decompress(x), "<u4") for x in (before, after))
    return shard, lang, zstandard.decompress(words).split(b"\n"), PhraseIndex(before, after)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _hashes(each: np.ndarray, grams: np.ndarray, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of the group and all words of each gram."""
    h = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        h = (h + each[grams[:, j]]) * np.uint64(odd)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _place(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value would stand in the sorted ``known``, and whether it does."""
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return at, known[at] == values if len(known) else np.zeros(len(values), bool)


def _listed(batch: pa.RecordBatch, column: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a list column, by hash; none for null."""
    found = batch.column(column)[row].values
    if found is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, counts = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
    order = np.argsort(grams)
    return grams[order], counts[order]


def word_counts(index: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (one word) and ``f``, over all shards."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, lang, words, held = _opened(batch, row)
                texts = pa.array(words[1:], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), texts, pa.array(held.counts[1:], pa.int64())], names=schema.names)

    return index.mapInArrow(run, schema).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _frequent(rows: DataFrame, least: int, out: str) -> DataFrame:
    """``shard`` and ``out``: the grams of a shard that occur ``least`` times in all shards together, as hashes with counts.

    A gram is a row per shard that holds it. The count is that of all shards in the first of them, 0 in the others. Grams
    of one hash, told apart by a second one, count together here, so none that is frequent is missing; their count is -1,
    and they are counted by their words.
    """
    every = Window.partitionBy("gram")
    second = F.shiftrightunsigned("f", 32)
    counted = rows.select(
        "shard", "gram", F.sum(F.col("f").bitwiseAND(0xFFFFFFFF)).over(every).alias("total"),
        (F.min(second).over(every) == F.max(second).over(every)).alias("alone"), F.min("shard").over(every).alias("first"),
    ).where(F.col("total") >= least)
    count = F.when(~F.col("alone"), -1).when(F.col("shard") == F.col("first"), F.col("total")).otherwise(0)
    return counted.groupBy("shard").agg(F.collect_list(F.struct("gram", count.cast("long").alias("count"))).alias(out))


#: ``f`` holds the count in its lower half, a second hash in its upper one.
_GRAMS = T.StructType([T.StructField(n, T.LongType()) for n in ("gram", "shard", "f")])


def _gram_rows(shard: int, each: np.ndarray, found: Phrases) -> pa.RecordBatch:
    second = _hashes(each, found.words, 0xD6E8FEB86659FD93).view(np.uint64) >> np.uint64(32)
    f = (second << np.uint64(32) | found.count.astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(_hashes(each, found.words)), pa.array(np.full(len(f), shard)), pa.array(f)], names=_GRAMS.names
    )


def frequent_pairs(index: DataFrame, least: int) -> DataFrame:
    """``shard``, ``pairs``: its word pairs that are frequent in all shards together."""

    def grams(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        shard, lang, words, held = _opened(batch, row)
        each = _word_hashes(lang, words)
        for found in held.steps(held.single()):
            yield _gram_rows(shard, each, found)

    return _frequent(index.mapInArrow(_by_row(grams), _GRAMS), least, "pairs")


def _by_row(made: Callable[[pa.RecordBatch, int], Iterator[pa.RecordBatch]]) -> Callable:
    """``made`` of each row in turn; what it holds of one shard is gone before the next is opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from made(batch, row)

    return run


def _pairs_of(held: PhraseIndex, each: np.ndarray, pairs: np.ndarray) -> Phrases:
    return held.longer(held.single(), keep=lambda found: _place(pairs, _hashes(each, found.words))[1])


def _triples_of(held: PhraseIndex, each: np.ndarray, frequent: np.ndarray, pairs: Phrases) -> Phrases:
    """Three words of which both pairs are frequent."""
    return held.longer(pairs, keep=lambda found: _place(frequent, _hashes(each, found.words[:, :2]))[1])


def frequent_triples(index: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """``shard``, ``triples``: the same of three words."""

    def grams(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        shard, lang, words, held = _opened(batch, row)
        each, frequent = _word_hashes(lang, words), _listed(batch, len(_INDEX), row)[0]
        yield _gram_rows(shard, each, _triples_of(held, each, frequent, _pairs_of(held, each, frequent)))

    return _frequent(index.join(pairs, "shard").select(*_INDEX.names, "pairs").mapInArrow(_by_row(grams), _GRAMS), least, "triples")


_COUNTS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("f", T.LongType()),
])


def phrase_counts(index: DataFrame, depth: int, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``size`` and ``f`` of all phrases of 2 to ``depth`` words that occur ``least`` times.

    Every part of a frequent phrase is frequent, so intervals are extended, behind and in front in turn, by frequent
    triples only. Pairs and triples are counted already: one shard writes them out; longer ones are summed over the shards.
    """
    pairs = staged(frequent_pairs(index, least), "pairs")
    release(index.sparkSession)
    triples = frequent_triples(index, pairs, least)

    def counted(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        _, lang, words, held = _opened(batch, row)
        each = _word_hashes(lang, words)
        known = {2 + i: _listed(batch, len(_INDEX) + i, row) for i in range(2)}
        phrases = _pairs_of(held, each, known[2][0])
        for size in range(2, depth + 1):
            if not len(phrases.low):
                break
            if size == 3:
                phrases = _triples_of(held, each, known[2][0], phrases)
            elif size > 3:
                behind = size % 2 == 0
                last = slice(-3, None) if behind else slice(3)
                phrases = held.longer(phrases, behind, lambda x, last=last: _place(known[3][0], _hashes(each, x.words[:, last]))[1])
            out, f = phrases, phrases.count
            if size in known:
                at, inside = _place(known[size][0], _hashes(each, phrases.words))
                phrases, count = phrases[inside], known[size][1][at[inside]]
                out, f = phrases[count != 0], np.where(count > 0, count, phrases.count)[count != 0]
            text = pa.array([b" ".join(map(words.__getitem__, w)) for w in out.words.tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(text), pa.string()), text, pa.array(np.full(len(text), size, np.int32)), pa.array(f, pa.int64())],
                names=_COUNTS.names,
            )

    # one plan with the triples: the index is dealt by shard once
    listed = index.join(pairs, "shard").join(triples, "shard", "left").select(*_INDEX.names, "pairs", "triples")
    return listed.mapInArrow(_by_row(counted), _COUNTS).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(
    docs: DataFrame, *, text: str = "text", group: str = "lang", depth: int = 5, least: int = 100, shard_words: int = 4_000_000
) -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the phrases of each group, not ranked.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends and into words at spaces and tabs. A
    phrase is 2 to ``depth`` words in a row inside a piece that occur ``least`` times (``a``) in its group; one that a
    longer phrase holds as often is left out. ``n`` is the number of words of the group, ``l`` and ``r`` the counts of the
    two parts of the cut with the lowest ``score``, the whole part of 1000 * a * n / (l * r), exactly; of equal ones the
    cut after fewest words. A null group is ``und``, null and empty texts have no words, repeated rows all count, an empty
    table has no phrases; other columns are not read. Any length of a text is one shard at most, about 0.3 kB a word.
    """
    index = build_index(docs, text=text, group=group, depth=depth, shard_words=shard_words)
    words = word_counts(index)
    phrases = staged(phrase_counts(index, depth, least), "collocations")
    release(docs.sparkSession)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = phrases.select("lang", "phrase", "f").unionByName(words.where(F.col("f") >= least))
    parts = F.split("phrase", " ")
    # the longer phrases that extend one in front or behind, as often as it occurs
    inner = [F.array_join(F.slice(parts, first, F.col("size") - 1), " ") for first in (1, 2)]
    longer = phrases.where("size > 2").select("lang", "f", F.explode(F.array(*inner)).alias("phrase")).distinct()
    cuts = phrases.join(longer, ["lang", "phrase", "f"], "left_anti").select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(parts, F.col("k") + 1, F.col("size")), " "))
    for part, count in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
    cuts = cuts.join(total, "lang")
    least_cut = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut")
    found = cuts.groupBy("lang", "phrase", "size", F.col("f").alias("a"), "n").agg(least_cut)
    return found.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")
