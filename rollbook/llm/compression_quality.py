"""Quality classifier: which of two trained zstandard dictionaries shrinks a text more."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import Scorer, as_bytes, filter_by_text, named, per_text, staged


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the logistic curve from the compressed sizes to the chance of label 1."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    prior: float
    piece: int
    level: int

    def features(self):
        """A function from a text's bytes to its normalised size difference (positive speaks for label 1), and the
        size by the good dictionary over the plain one with its square: endless repetition shrinks under both."""
        def compressor(dictionary: bytes):
            trained = zstandard.ZstdCompressionDict(dictionary)
            trained.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(
                level=self.level, dict_data=trained, write_checksum=False, write_content_size=False, write_dict_id=False
            )

        good, bad = compressor(self.good), compressor(self.bad)

        def measure(text: bytes) -> tuple[float, float, float]:
            # pieces are compressed alone: a long text would else teach the compressor its own words
            small = large = 0
            for at in range(0, len(text), self.piece):
                part = text[at : at + self.piece]
                small += len(good.compress(part))
                large += len(bad.compress(part))
            return (large - small) / (large + small), small / len(text), (small / len(text)) ** 2

        return measure

    def scorer(self) -> Scorer:
        if not self.good:
            return lambda texts: [pa.array([self.prior] * len(texts), pa.float64())]
        measure = self.features()

        def score(texts: pa.Array) -> list[pa.Array]:
            out = [self.chance(measure(t)) if t else self.prior for t in as_bytes(texts)]
            return [pa.array(out, pa.float64())]

        return score

    def chance(self, features: tuple[float, ...]) -> float:
        x = self.curve[0] + sum(w * f for w, f in zip(self.curve[1:], features, strict=True))
        return 1 / (1 + math.exp(-min(max(x, -40.0), 40.0)))


def _dictionary(texts: list[bytes], size: int, piece: int) -> bytes:
    parts = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, parts)) // 4)), parts).as_bytes()
    except zstandard.ZstdError:  # too little text for statistics: its end is the dictionary
        return b"".join(parts)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Offset and slopes by Newton steps that lower the loss, with a slight pull to zero."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(design.shape[1])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.05 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 0.1 * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(w))
        step, now = np.linalg.solve(bend, slope), loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:  # a full step may overshoot
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def fit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label",
    sample_rows: int = 2000, dictionary_bytes: int = 65_536, piece: int = 512, level: int = 3,
) -> CompressionModel:
    """Train on a bounded sample of ``docs`` with a row in ``labels``: of each label (0 and 1) the ``sample_rows``
    keys with the smallest hash, their texts whole. The driver holds these texts while it trains.

    The curve is learnt from sizes under dictionaries of the other half of the sample, each half in turn; the
    dictionaries that are kept come from all of it. Null keys and labels, and null or empty texts, teach
    nothing; repeated rows are one, and a key of both labels is not used. Without two rows of both labels every
    text gets the share of label 1 among the keys seen, 0.5 if there are none. Keys meet labels without texts.
    """
    known = labels.select(named(key).alias("k"), named(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("k", "y")
    filled = docs.where(F.length(named(text)) > 0).select(named(key).alias("k")).distinct()
    known = staged(known.join(filled, "k"), "labelled").withColumn("h", F.xxhash64("k"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    first = [known.where(F.col("y") == y).orderBy("h", "k").limit(sample_rows) for y in (0, 1)]
    # at most twice sample_rows keys, so they are broadcast
    chosen = F.broadcast(staged(first[0].unionByName(first[1]), "sample").withColumnsRenamed({"k": "__k", "y": "__y", "h": "__h"}))
    body = F.col("body")
    texts = docs.select(named(key).alias("__k"), named(text).alias("body")).where(F.length(body) > 0).join(chosen, "__k")
    texts = texts.groupBy("__k").agg(F.first("__y").alias("y"), F.first("__h").alias("h"), F.min("body").alias("w"))
    groups: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(texts.collect(), key=lambda r: (r["h"], r["__k"])):
        groups[r["y"]].append(r["w"].encode())
    if min(len(groups[0]), len(groups[1])) < 2:
        return CompressionModel(b"", b"", (), prior, piece, level)
    def trained(of: dict[int, list[bytes]], curve: tuple[float, ...] = ()) -> CompressionModel:
        good, bad = (_dictionary(of[y], dictionary_bytes, piece) for y in (1, 0))
        return CompressionModel(good, bad, curve, prior, piece, level)

    x, target = [], []
    for half in (0, 1):
        measure = trained({y: groups[y][half::2] for y in groups}).features()
        for y in groups:
            x += [measure(t) for t in groups[y][1 - half :: 2]]
            target += [y] * len(groups[y][1 - half :: 2])
    curve = _logistic(np.array(x), np.array(target, float))
    # the sample holds the labels in other shares than the rows do
    seen = float(np.mean(target))
    shift = math.log(prior / (1 - prior)) - math.log(seen / (1 - seen))
    return trained(groups, (curve[0] + shift, *curve[1:]))


def score(docs: DataFrame, model: CompressionModel, *, text: str = "text", keep: list[str], out: str = "score") -> DataFrame:
    """``keep`` and ``out``, the chance of label 1, from each whole text.

    Null and empty texts get the share of label 1. Repeated rows score alike; other columns are dropped. The
    model is a few hundred kB and travels with the task.
    """
    return per_text(docs, text, keep, [T.StructField(out, T.DoubleType())], model.scorer)


def keep_good(docs: DataFrame, model: CompressionModel, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` whose score is at least ``threshold``; all columns as they are."""
    def make():
        score = model.scorer()
        return lambda texts: pc.greater_equal(score(texts)[0], threshold)

    return filter_by_text(docs, text, make)
