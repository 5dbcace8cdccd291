"""Stupid-backoff scores of documents from n-gram counts of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import as_bytes, named, slices

# kind 0: documents of a group; 1: n-grams of a group in a bucket, with their counts by fold
_ROWS = T.StructType([
    T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])
_SCORES = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("total", T.DoubleType()),
])
# what a document begins with, and any word: no word has white space
_START, _ANY = (xxhash.xxh64_intdigest(x) for x in (b" ", b"  "))
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes, bits: int | None = None) -> np.ndarray:
    """The hash of each word: words are lower-cased (A-Z) and split at ASCII white space; with ``bits`` 1 .. 2**bits - 1."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return hashes if bits is None else hashes % np.uint64((1 << bits) - 1) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers of one length, byte by byte: high bytes are mostly alike."""
    planes = b"".join(np.ascontiguousarray(c, "<u8").view("u1").reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def _words(texts: list[bytes], bits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a group behind two names, for what a document begins with and for any word; the
    places there of the words of all texts; the number of words of each text."""
    hashes = [word_hashes(t, bits) for t in texts]
    found, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    special = np.array([_START, _ANY] if bits is None else [0, 1 << bits], np.uint64)
    return np.concatenate([special, found]), ids + len(special), np.array([len(h) for h in hashes], np.int64)


def _before(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each; 0 before the first of a document."""
    first = np.roll(ids, 1)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return first


def _entries(names: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of a group's words and pairs; the place there of each name, and of the pair at each word."""
    pair, at = np.unique(first * len(names) + ids, return_inverse=True)
    a, b = np.divmod(pair, len(names))
    keys = np.concatenate([_mixed(names + _ONE), _mixed(_mixed(names[a] + _TWO) + names[b])])
    keys, place = np.unique(keys, return_inverse=True)
    return keys, place[: len(names)], place[len(names) :][at]


def _grams(rows: DataFrame, bits: int | None, buckets: int, group: int, group_bytes: int) -> DataFrame:
    """Per group of documents: its documents, and by bucket the counts of its words and pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for whole in batches:
            texts_of = whole.column(2)
            for start, stop in ((a, min(a + group, stop)) for first, stop in slices(texts_of, group_bytes) for a in range(first, stop, group)):
                part = whole.slice(start, stop - start)
                seq += 1
                keys_of, folds = part.column(0).to_pylist(), np.array(part.column(1).to_pylist(), np.int64)
                texts = as_bytes(part.column(2))
                yield _row(seq, 0, -1 - int(seq % buckets), _documents(keys_of, folds, texts))
                names, ids, sizes = _words(texts, bits)
                del texts
                keys, of_name, of_pair = _entries(names, ids, _before(ids, sizes))
                of_word, of_fold = of_name[ids], np.repeat(folds, sizes)
                counts = np.zeros((2, len(keys)), np.int64)
                for f in (0, 1):
                    mine = of_fold == f
                    counts[f] = np.bincount(of_word[mine], minlength=len(keys)) + np.bincount(of_pair[mine], minlength=len(keys))
                    counts[f, of_name[0]] += np.count_nonzero(sizes[folds == f])
                    counts[f, of_name[1]] += np.count_nonzero(mine)
                edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    s, e = edges[k], edges[k + 1]
                    yield _row(seq, 1, k, _pack(np.diff(keys[s:e], prepend=np.uint64(0)), *counts[:, s:e]))

    return rows.mapInArrow(run, _ROWS)


def _documents(keys: list, folds: np.ndarray, texts: list[bytes]) -> bytes:
    known = np.array([k is not None for k in keys], np.int64)
    head = _pack(np.array([k or 0 for k in keys], np.int64), known, folds, np.array([len(t) for t in texts], np.int64))
    # smaller than numbered words with their hashes
    return len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def _documents_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    end = 8 + int.from_bytes(data[:8], "little")
    keys, known, folds, lengths = (x.astype(np.int64) for x in _unpack(data[8:end], 4))
    whole, ends = zstandard.ZstdDecompressor().decompress(data[end:]), np.cumsum(lengths).tolist()
    return keys, known, folds, [whole[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts], axis=1)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[:, order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=1)


def _answers(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """To each group the counts in the corpus of what it has in a bucket, in the order in which it gave them."""
    parts, fresh = [], 0
    for _, data in asked:
        gaps, *counts = _unpack(data, 3)
        parts.append((np.cumsum(gaps, dtype=np.uint64), np.stack(counts)))
        fresh += len(gaps)
        # what is merged at least doubles, so no key is sorted more than a few times
        if fresh > max(1 << 20, len(parts[0][0])):
            parts, fresh = [_merge(parts)], 0
    keys, counts = _merge(parts)
    del parts
    for batch, data in asked:
        mine = np.searchsorted(keys, np.cumsum(_unpack(data, 3)[0], dtype=np.uint64))
        yield _row(batch, 1, bucket, _pack(*counts[:, mine]))


def _scored(documents: bytes, answers: list[bytes], bits: int | None, alpha: float) -> pa.RecordBatch:
    keys, known, folds, texts = _documents_of(documents)
    names, ids, sizes = _words(texts, bits)
    first = _before(ids, sizes)
    _, of_name, of_pair = _entries(names, ids, first)
    given = [_unpack(a, 2) for a in answers]
    counts = np.stack([np.concatenate([g[f] for g in given]) for f in (0, 1)]).astype(np.float64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    other = 1 - folds[doc]
    seen = counts[other, of_pair]
    logs = np.log(np.maximum(counts, 1))
    alone = np.log(alpha) + logs[other, of_name[ids]] - logs[other, of_name[1]]
    value = np.where(seen > 0, logs[other, of_pair] - logs[other, of_name[first]], alone)
    total, hits = (np.bincount(doc, x, len(sizes)) for x in (value, seen > 0))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, mask=known == 0), pa.array(sizes), pa.array(hits.astype(np.int64)), pa.array(total.astype(np.float64))], names=_SCORES.names
    )


def score(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", fold: Column | None = None, bits: int | None = None,
    alpha: float = 0.4, bucket_chars: int = 100_000_000, group: int = 512,
    group_bytes: int = 8_000_000,
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_seen`` (words that follow the word before them in the other
    fold too), ``log_score`` (sum of natural logarithms) and ``perplexity``.

    A word after another scores count(pair) / count(first), or ``alpha`` times count(word) / count(all words) if
    the pair is unknown; an unknown word counts as one. Documents are in two folds, 0 and 1 (``fold``; null and by
    default crc32 of the key modulo 2, 0 for a null key), and each is scored by the counts of all documents of the
    other fold. Words and pairs are known by 64-bit hashes and neither is bounded: both are counted in hash buckets,
    the number of which follows the corpus, and the counts go back to the groups of documents that have them. With
    ``bits`` words are folded into 2**bits - 1 classes first. Null and empty texts have no words, score 0 and a null
    perplexity. Repeated rows are documents of their own. Other columns are dropped; an empty table gives an empty one.
    A group is up to ``group`` documents of about ``group_bytes`` bytes, or one longer text.
    """
    if not 1 <= group <= 1 << 16:
        raise ValueError("a group holds 1 to 65536 documents")
    spark = docs.sparkSession
    default = F.crc32(named(key).cast("string").cast("binary")) % 2
    rows = docs.select(
        named(key).cast("long").alias("k"), F.coalesce(fold if fold is not None else default, F.lit(0)).cast("int").alias("f"),
        F.coalesce(named(text), F.lit("")).alias("t"),
    )
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, int(chars // bucket_chars) + 1)
    grams = _grams(rows, bits, buckets, group, group_bytes).repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = None, []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["kind"] == 0:
                    yield _row(row["batch"], 0, row["bucket"], row["data"])
                    continue
                if row["bucket"] != at:
                    if asked:
                        yield from _answers(at, asked)
                    at, asked = row["bucket"], []
                asked.append((row["batch"], row["data"]))
        if asked:
            yield from _answers(at, asked)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, answers = None, []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["kind"] == 0:
                    if documents is not None:
                        yield _scored(documents, answers, bits, alpha)
                    documents, answers = row["data"], []
                else:
                    answers.append(row["data"])
        if documents is not None:
            yield _scored(documents, answers, bits, alpha)

    sums = grams.mapInArrow(run, _ROWS).repartition(tasks, "batch").sortWithinPartitions("batch", "kind", "bucket")
    return sums.mapInArrow(add, _SCORES).select(
        F.col("k").alias(key), F.col("n").alias("n_words"), F.col("seen").alias("n_seen"), F.col("total").alias("log_score"),
        F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))).alias("perplexity"),
    )


def _row(batch: int, kind: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([batch], pa.int64()), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=_ROWS.names
    )
