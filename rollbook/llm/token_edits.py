"""Token counts under edits: segment trees of pre-token counts, re-encoded only where an edit touches them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import Scorer, as_text, named, per_text
from rollbook.llm.token_blocks import word_encoder

#: Before a single space between two visible characters no token of the tokenizer goes on.
CUT = re.compile(r"(?<=\S)(?= \S)")

EDITS = "array<struct<start:int,end:int,text:string>>"


def segments(text: str, chars: int, most: int | None = None) -> list[str]:
    """The text cut at such places into parts of ``chars`` characters or more, ``most`` parts at most."""
    parts, start = [], 0
    while most is None or len(parts) < most - 1:
        found = CUT.search(text, start + chars)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


class SegmentTree:
    """Character lengths and token counts of a document's segments under a tree of token sums."""

    def __init__(self, lengths: list[int], counts: list[int], sums: list[int] | None = None):
        self.lengths, self.counts = lengths, counts
        self.base = 1 << max(0, (len(counts) - 1).bit_length())
        self.touched = 0
        if sums is not None:
            self.sums = sums
            return
        self.sums = [0] * (2 * self.base)
        self.sums[self.base : self.base + len(counts)] = counts
        for node in range(self.base - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def set(self, leaf: int, length: int, count: int) -> None:
        """Change a leaf and the sums above it."""
        self.lengths[leaf], change = length, count - self.counts[leaf]
        self.counts[leaf] = count
        node = self.base + leaf
        while change and node:
            self.sums[node] += change
            self.touched += 1
            node //= 2


class Counter:
    """Builds trees, and applies edits to them."""

    def __init__(self, tokenizer: str, chars: int):
        self.encoder, self.chars = word_encoder(tokenizer), chars

    def count(self, parts: list[str]) -> list[int]:
        return self.encoder.count(parts)

    def build(self, texts: list[str]) -> list[SegmentTree]:
        split = [segments(t, self.chars) for t in texts]
        counts = self.count([p for parts in split for p in parts])
        out, at = [], 0
        for parts in split:
            out.append(SegmentTree([len(p) for p in parts], counts[at : at + len(parts)]))
            at += len(parts)
        return out

    def apply(self, tree: SegmentTree, text: str, edits: list[tuple[int, int, str]]) -> tuple[int, int, int]:
        """Apply the edits to the tree; give back how many took effect, and the characters before and after.

        The segments from the one that holds the second character before an edit to the one that holds the second
        behind it are re-encoded: what stands at their outer borders is unchanged, so no token crosses them.
        """
        ends = np.cumsum(tree.lengths)
        regions: list[tuple[int, int, list[tuple[int, int, str]]]] = []
        done = -1
        for start, end, new in sorted(edits, key=lambda e: (e[0], e[1])):
            if not 0 <= start <= end <= len(text) or start < done:
                continue
            done = end
            first = int(np.searchsorted(ends, max(start - 2, 0), "right"))
            last = int(np.searchsorted(ends, end + 1, "right"))
            first, last = min(first, len(ends) - 1), min(last, len(ends) - 1)
            if regions and first <= regions[-1][1]:
                first, _, inside = regions.pop()
                regions.append((first, last, [*inside, (start, end, new)]))
            else:
                regions.append((first, last, [(start, end, new)]))
        taken = encoded = 0
        for first, last, inside in regions:
            begin, stop = int(ends[first] - tree.lengths[first]), int(ends[last])
            pieces, at = [], begin
            for start, end, new in inside:
                pieces += [text[at:start], new]
                at = end
            body = "".join([*pieces, text[at:stop]])
            parts = segments(body, self.chars, last - first + 1)
            parts += [""] * (last - first + 1 - len(parts))
            for leaf, (part, n) in enumerate(zip(parts, self.count(parts), strict=True), first):
                tree.set(leaf, len(part), n)
            taken += len(inside)
            encoded += len(body)
        return taken, encoded, sum(tree.lengths)


_TREE = [
    T.StructField("n_tokens", T.LongType()), T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("sums", T.ArrayType(T.LongType())),
]


def build_trees(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: list[str], chars: int = 256) -> DataFrame:
    """``keep`` and the segment tree of each whole text: ``n_tokens``, ``lengths`` and ``counts`` of its segments of
    about ``chars`` characters, ``sums`` of the tree above them. A null text is empty: one segment, no token. A text of any length is one
    tree; repeated rows get equal ones; an empty table gives an empty one."""
    def make() -> Scorer:
        counter = Counter(tokenizer, chars)

        def score(texts: pa.Array) -> list[pa.Array]:
            trees = [t for at in range(0, len(texts), 128) for t in counter.build(as_text(texts[at : at + 128]))]
            return [
                pa.array([t.total for t in trees], pa.int64()), pa.array([t.lengths for t in trees], pa.list_(pa.int32())),
                pa.array([t.counts for t in trees], pa.list_(pa.int32())), pa.array([t.sums for t in trees], pa.list_(pa.int64())),
            ]

        return score

    return per_text(docs, text, keep, _TREE, make)


def apply_edits(trees: DataFrame, tokenizer: str, edits: Column, *, key: str = "doc_id", text: str = "text", chars: int = 256) -> DataFrame:
    """One row per row of ``trees``: ``key``, ``n_tokens`` before, ``n_edits`` that took effect, ``n_tokens_after``,
    ``n_chars_after``, ``chars_encoded`` (of the touched segments, new text included) and ``sums_updated``.

    ``edits`` is an array of (start, end, text) on code points of the old text, end exclusive; null is none. They
    are taken by start; one that leaves the text or begins inside an earlier one has no effect, a null text inserts
    nothing. Old texts are read only around edits. Each row stands alone: nothing is shuffled. An empty table gives an
    empty one; a key named like one of the counts is an error.
    """
    long = T.LongType()
    rows = trees.select(
        named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("t"), "n_tokens", "lengths", "counts", "sums",
        F.coalesce(edits, F.array().cast(EDITS)).alias("edits"),
    )
    names = ["n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "chars_encoded", "sums_updated"]
    if key in names:
        raise ValueError(f"the key is named like a count: {key}")
    schema = T.StructType([T.StructField("k", trees.schema[key].dataType), *(T.StructField(n, long) for n in names)])

    def run(batches):
        counter = Counter(tokenizer, chars)
        for batch in batches:
            out = []
            edits = batch.column(6).to_pylist()
            before = batch.column(2).to_pylist()
            for i, changes in enumerate(edits):
                changes = [(e["start"], e["end"], e["text"] or "") for e in changes if e and None not in (e["start"], e["end"])]
                if not changes:
                    lengths = batch.column(3)[i].values
                    out.append((before[i], 0, before[i], int(np.sum(lengths.to_numpy())), 0, 0))
                    continue
                tree = SegmentTree(*(batch.column(c)[i].as_py() for c in (3, 4, 5)))
                taken, encoded, length = counter.apply(tree, batch.column(1)[i].as_py(), changes)
                out.append((before[i], taken, tree.total, length, encoded, tree.touched))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
