"""SimHash fingerprints and their near duplicates by BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import Scorer, as_bytes, named, per_text, staged, unused
from rollbook.llm.components import components

FP = "fp"
MEMBERS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _hasher(shingle: int, seed: int):
    """A function from a text's bytes to its 64-bit fingerprint."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    lanes = 256 * np.arange(8)
    xxh = xxhash.xxh64_intdigest

    def fingerprint(text: bytes) -> int:
        words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
        if not words:
            return 0
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        k = min(shingle, len(words))
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
        spans = zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)
        hashes = np.fromiter((xxh(line[s:e], seed) for s, e in spans), np.uint64, len(starts))
        votes = np.zeros((8, 8), np.int64)
        for at in range(0, len(hashes), 1 << 20):
            part = hashes[at : at + (1 << 20)].astype("<u8").view(np.uint8).reshape(-1, 8)
            votes += (np.bincount((part + lanes).ravel(), minlength=2048).reshape(8, 256)) @ bits
        set_bits = (2 * votes > len(hashes)).reshape(-1)
        return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])

    return fingerprint


def fingerprints(
    docs: DataFrame, *, text: str = "text", keep: list[str], shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``keep`` and ``fp`` (the 64 bits as a signed long): the majority bits of the XXH64 of all word shingles.

    A-Z are lower-cased, words split at ASCII white space, repeats count. Fewer words than a shingle are one
    shingle; a null text or one without words has fingerprint zero.
    """
    def make() -> Scorer:
        one = _hasher(shingle, seed)

        def score(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(np.array([one(t) for t in as_bytes(texts)], np.uint64).view(np.int64))]

        return score

    return per_text(docs, text, keep, [T.StructField(FP, T.LongType())], make)


class BKTree:
    """Fingerprints under children keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if not new:
            return
        node = 0
        while True:
            away = (self.values[node] ^ value).bit_count()
            below = self.children[node].setdefault(away, new)
            if below == new:
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values at ``radius`` bits or fewer; only edges that can lead to one are followed."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            away = (self.values[node] ^ value).bit_count()
            if away <= radius:
                yield node
            children = self.children[node]
            if len(children) > 2 * radius + 1:
                stack.extend(children[d] for d in range(away - radius, away + radius + 1) if d in children)
            else:
                stack.extend(c for d, c in children.items() if -radius <= d - away <= radius)


class Shard:
    """One tree of one shard. Its fingerprints come first, then those of the shard's other trees."""

    def __init__(self, radius: int) -> None:
        self.tree, self.radius = BKTree(), radius
        self.root: list[int] = []

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def add(self, value: int) -> None:
        self.root.append(len(self.root))
        self.tree.add(value)

    def inner(self) -> Iterator[tuple[int, int]]:
        """Links that connect the tree's own fingerprints, at most one each."""
        values = self.tree.values
        if len(values) < 2:
            return
        for place, value in enumerate(values):
            for other in self.tree.within(value, self.radius):
                a, b = self._find(place), self._find(other)
                if a != b:
                    self.root[max(a, b)] = min(a, b)
                    yield value, values[other]

    def outer(self, value: int) -> Iterator[tuple[int, int]]:
        """Links of a fingerprint from outside, one to each connected part of the tree that it meets."""
        met = {self._find(place): place for place in self.tree.within(value, self.radius)}
        for place in met.values():
            yield value, self.tree.values[place]


def _tables(blocks: int, radius: int) -> list[Column]:
    """One shard key for each choice of blocks on which two fingerprints within the radius must agree."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    keys = []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        parts = [F.shiftrightunsigned(FP, int(edges[c])).bitwiseAND((1 << int(edges[c + 1] - edges[c])) - 1) for c in chosen]
        keys.append(F.xxhash64(F.lit(table), *parts))
    return keys


def links(prints: DataFrame, *, radius: int = 3, blocks: int = 5, tree_rows: int = 4096) -> DataFrame:
    """``a``, ``b``: links that connect all distinct ``fp`` at ``radius`` bits or fewer, as a spanning set.

    Of ``blocks`` bit blocks two such fingerprints agree on ``blocks - radius`` at least, so they meet in a
    shard of one such choice. Each shard is a BK-tree that its own fingerprints search. A shard of over
    ``tree_rows`` becomes several trees, each in a task of its own, and its fingerprints search all of them.
    """
    session = prints.sparkSession
    keyed = prints.select(FP, F.explode(F.array(*_tables(blocks, radius))).alias("shard"))
    large = keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_rows)
    large = large.select("shard", F.ceil(F.col("n") / tree_rows).cast("int").alias("parts"))
    keyed = keyed.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit("part"), FP), "parts").cast("int")
    keyed = keyed.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.select("shard", "part", (F.col("own") == F.col("part")).alias("inside"), FP)
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", F.desc("inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, open_ = None, Shard(radius), False
        for batch in batches:
            shard, part, inside = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            values = batch.column(3).to_numpy().view(np.uint64).tolist()
            found: list[tuple[int, int]] = []
            for key, value, own in zip(zip(shard.tolist(), part.tolist(), strict=True), values, inside.tolist(), strict=True):
                if key != at:
                    if open_:
                        found.extend(now.inner())
                    at, now, open_ = key, Shard(radius), True
                if own:
                    now.add(value)
                    continue
                if open_:
                    found.extend(now.inner())
                    open_ = False
                found.extend(now.outer(value))
            yield _pairs(found)
        if open_:
            yield _pairs(list(now.inner()))

    return dealt.mapInArrow(run, MEMBERS)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def groups(prints: DataFrame, key: str, *, radius: int = 3) -> DataFrame:
    """``fp``, ``root`` (the smallest fingerprint linked to it) and ``component``, the smallest non-null ``key``
    (a long) of all rows linked to it."""
    distinct = staged(prints.groupBy(FP).agg(F.min(named(key)).alias("least")), "fingerprints")
    roots = components(links(distinct.select(FP), radius=radius))
    joined = distinct.join(roots.withColumnRenamed("node", FP), FP, "left").withColumn("root", F.coalesce("root", FP))
    named_roots = joined.groupBy("root").agg(F.min("least").alias("component"))
    return staged(joined.join(named_roots, "root").select(FP, "root", "component"), "groups")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fp``, ``fingerprint`` (16 hex digits) and ``component``.

    Exact copies share a fingerprint and are one node, so a group of copies of any size adds no link. Rows
    with a null key join groups by their text but never name them; a group without any key has a null
    component. Other columns are dropped. An empty table gives none.
    """
    rows = staged(fingerprints(docs, text=text, keep=[key], shingle=shingle), "prints")
    labels = groups(rows, key, radius=radius)
    out = rows.join(labels, FP)
    return out.select(named(key), FP, F.lower(F.lpad(F.hex(FP), 16, "0")).alias("fingerprint"), "component")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest key, nulls last.

    A row is known by its key and the hash of its text; of rows equal in both one stays. All columns are
    returned as they are, whatever their names. Texts meet the kept keys in one join; fingerprints and links hold no
    text. Null and empty texts share fingerprint zero and so are one group; an empty table gives an empty one.
    """
    body = F.coalesce(named(text), F.lit(""))
    skinny = docs.select(named(key).alias("k"), F.xxhash64(body).alias("h"), body.alias("t"))
    rows = staged(fingerprints(skinny, text="t", keep=["k", "h"], shingle=shingle), "prints")
    labels = groups(rows, "k", radius=radius)
    order = F.struct(F.col("k").isNull().alias("no_key"), "k", "h")
    first = rows.groupBy(FP).agg(F.min(order).alias("first")).join(labels, FP)
    chosen = first.groupBy("root").agg(F.min("first").alias("first")).select("first.k", "first.h")
    times = rows.groupBy("k", "h").agg(F.count("*").alias("times"))
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2"))
    chosen = chosen.distinct().join(times.withColumnsRenamed({"k": "k2", "h": "h2"}), same)
    k, h, n = unused(docs, "__k", "__h", "__times")
    chosen = staged(chosen.select(F.col("k").alias(k), F.col("h").alias(h), F.col("times").alias(n)), "kept")
    match = named(key).eqNullSafe(F.col(k)) & (F.xxhash64(body) == F.col(h))
    once = docs.join(chosen.where(F.col(n) == 1), match, "left_semi")
    several = docs.join(chosen.where(F.col(n) > 1), match).dropDuplicates([k, h])
    return once.unionByName(several.select(*(named(c) for c in docs.columns)))
