"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import Scorer, as_text, named, per_text

#: A letter by its Unicode category, in Python and in Spark's expressions; digits in circles or above the line are none.
LETTERS = r"\p{L}"
LETTER = regex.compile(LETTERS)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd multipliers, one a place


def features(texts: list[str], bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the document and the hashed feature of every character n-gram that lies in one text.

    Texts are lower-cased, each run of other characters than letters is one space, and a space stands at
    either end, so word beginnings and ends count.
    """
    padded = [" " + _SPACES.sub(" ", t.lower()).strip() + " " for t in texts]
    lengths = np.array([len(t) for t in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    for order in orders:
        n = max(0, len(codes) - order + 1)
        key = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for j in range(order):
            key = (key ^ codes[j : j + n]) * _MIX[j % 3]
            key ^= key >> np.uint32(15)
        inside = doc[:n] == doc[order - 1 : order - 1 + n]
        yield doc[:n][inside], (key >> np.uint32(32 - bits))[inside]


_SPACES = re.compile(r"(?:[\W\d_])+")


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of each feature (rows) in each language (columns), and of each language."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    bits: int
    orders: tuple[int, ...]


def _count(labelled: DataFrame, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """``lang``, ``feature`` (-1: documents) and ``n``, summed in each task before they are shuffled."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("feature", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(langs), 256):
                part, body = langs[at : at + 256], as_text(texts[at : at + 256])
                known = sorted(set(part))
                number = np.array([known.index(x) for x in part], np.int64)
                for lang in part:
                    docs[lang] = docs.get(lang, 0) + 1
                for doc, feature in features(body, bits, orders):
                    table = np.bincount((number[doc] << bits) | feature, minlength=len(known) << bits).reshape(-1, 1 << bits)
                    for k, lang in enumerate(known):
                        counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                        counts[lang] += table[k]
        for lang, table in counts.items():
            seen = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(seen) + 1)), pa.array(np.append(seen, -1).astype(np.int32)),
                pa.array(np.append(table[seen], docs[lang])),
            ], names=schema.names)

    return labelled.mapInArrow(run, schema).groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", bits: int = 16, orders: tuple[int, ...] = (1, 2, 3),
    alpha: float = 0.5, max_languages: int = 200,
) -> LanguageModel:
    """Learn from every row with a text that has a letter and a language that isn't null.

    The model is a matrix of 2**bits features by languages; more than ``max_languages`` are an error, so it has
    a bound (0.25 MB a language at 16 bits) and may be collected and sent to all tasks. No rows: no languages.
    """
    rows = docs.where(named(lang).isNotNull() & named(text).rlike(LETTERS)).select(
        named(lang).alias("lang"), named(text).alias("text")
    )
    summed = _count(rows, bits, orders).toArrow()
    languages = sorted(set(summed.column("lang").to_pylist()))
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages; raise max_languages if that many are meant")
    counts = np.zeros((1 << bits, len(languages)))
    documents = np.zeros(len(languages))
    place = {x: i for i, x in enumerate(languages)}
    column = np.array([place[x] for x in summed.column("lang").to_pylist()], np.int64)
    feature, n = summed.column("feature").to_numpy(), summed.column("n").to_numpy()
    total = feature < 0
    documents[column[total]] = n[total]
    counts[feature[~total], column[~total]] = n[~total]
    smooth = counts + alpha
    matrix = np.log(smooth) - np.log(smooth.sum(axis=0))
    prior = np.log(documents) - np.log(documents.sum()) if languages else documents
    return LanguageModel(languages, prior, matrix.astype(np.float32), bits, orders)


def predict(
    docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str], out: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``keep``, the likeliest language of each whole text and its probability under the model.

    ``und`` with score 0 for texts that are null or have no letter, and for all texts if the model has no
    language. Ties go to the language first in code point order. The score is the posterior with the evidence
    of a text's n-grams, which overlap, counted as that of one n-gram a character.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.languages, model.prior, model.matrix))
    bits, orders = model.bits, model.orders

    def make() -> Scorer:
        languages, prior, matrix = held.value
        group = max(1, min(64, 256 // max(1, len(languages))))

        def sums(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), len(languages)))
            for doc, feature in features(texts, bits, orders):
                for at in range(0, len(doc), 1 << 18):  # long texts in steps, all of them
                    d, f = doc[at : at + (1 << 18)], feature[at : at + (1 << 18)]
                    starts = np.flatnonzero(np.diff(d, prepend=-1))
                    out[d[starts]] += np.add.reduceat(matrix[f], starts, axis=0, dtype=np.float64)
            return out / len(orders) + prior

        def score_batch(texts: pa.Array) -> list[pa.Array]:
            names: list[str] = []
            chances: list[float] = []
            for at in range(0, len(texts), group):
                part = as_text(texts[at : at + group])
                spoken = [bool(languages) and bool(LETTER.search(t)) for t in part]
                total = sums(part) if any(spoken) else np.zeros((len(part), max(1, len(languages))))
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names += [languages[b] if ok else "und" for b, ok in zip(best, spoken, strict=True)]
                chances += [float(s) if ok else 0.0 for s, ok in zip(share, spoken, strict=True)]
            return [pa.array(names, pa.string()), pa.array(chances, pa.float64())]

        return score_batch

    return per_text(docs, text, keep, [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())], make)
