"""Phrases by FM-indexes against a count of all phrases."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import phrase_index
from tests.llm import messy

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str | None) -> list[list[str]]:
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows: list[tuple[str | None, str | None]], depth: int, least: int) -> list[tuple]:
    f: Counter = Counter()
    n: Counter = Counter()
    for text, lang in rows:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, depth + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    frequent = {x: c for x, c in f.items() if c >= least}
    covered = {(lang, p, c) for (lang, w), c in frequent.items() for p in (w[1:], w[:-1])}
    for (lang, w), a in frequent.items():
        if len(w) < 2 or (lang, w, a) in covered:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), len(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("shard_words", [40, 10_000_000])
def test_collocations(spark, shard_words):
    r = random.Random(5)
    common = ["big red dog", "in spite of", "new york city hall", "a a a a a a", "x y"]
    rows = []
    for i in range(300):
        words = [r.choice(common) if r.random() < 0.4 else r.choice("abcdefgh") for _ in range(r.randint(0, 25))]
        rows.append(("".join(w + r.choice([" ", "\t ", ", ", "\n", " "]) for w in words).title(), r.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", "de"), ("  \n", None), ("New York City Hall." * 300, "fr")]
    docs = table(spark, rows).repartition(4)
    got = phrase_index.collocations(docs, depth=5, least=8, shard_words=shard_words)
    want = brute(rows, 5, 8)
    assert len(want) > 40
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("turns", [(False,) * 4, (True,) * 4, (False, True, False, True), (True, False, False, True)])
def test_index_counts_and_extends(turns):
    r = np.random.default_rng(3)
    ids = np.append(r.integers(0, 5, 400), 0)
    held = phrase_index.PhraseIndex(*phrase_index.PhraseIndex.transforms(ids, 6))
    phrases = held.single()
    text = ids.tolist()
    for size, behind in enumerate((*turns, False), 1):
        want = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1) if 0 not in text[i : i + size])
        assert {tuple(w): c for w, c in zip(phrases.words.tolist(), phrases.count.tolist(), strict=True)} == want
        phrases = held.longer(phrases, behind)


def test_grams_of_one_hash(spark):
    """Grams that differ in the second hash are left to be counted by their words."""
    rows = [(1, 10, 5 << 32 | 3), (1, 11, 5 << 32 | 4), (2, 10, 7 << 32 | 5), (2, 11, -(8 << 32) | 5), (3, 10, 1 << 32 | 2), (4, 12, -1 << 32 | 9)]
    got = phrase_index._frequent(spark.createDataFrame(rows, "gram long, shard long, f long"), 5, "out").collect()
    assert {r["shard"]: sorted(tuple(x) for x in r["out"]) for r in got} == {10: [(1, 7), (2, -1)], 11: [(1, 0), (2, -1)], 12: [(4, 9)]}


def test_awkward_rows(spark):
    docs = messy.documents(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    got = phrase_index.collocations(docs, least=3)
    assert got.columns == ["lang", "phrase", "size", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 3)
    assert phrase_index.collocations(messy.empty(spark)).collect() == []


def test_scores_past_64_bits(spark):
    """The score is exact where 1000 * f * n and l * r are no 64-bit numbers."""
    r = random.Random(1)
    rows = [(r.randint(100, 10**12), r.randint(10**12, 9 * 10**14), 0, 0) for _ in range(200)]
    rows = [(f, n, r.randint(f, 10**14), r.randint(f, 10**14)) for f, n, _, _ in rows]
    got = spark.createDataFrame(rows, "f long, n long, l long, r long").selectExpr("f", "n", "l", "r", phrase_index.SCORE + " AS score").collect()
    assert sorted(tuple(x) for x in got) == sorted((f, n, a, b, 1000 * f * n // (a * b)) for f, n, a, b in rows)


def test_phrases_are_extended_in_steps():
    """Steps of any size find the same; what a step holds does not grow with the shard."""
    r = np.random.default_rng(4)
    ids = np.append(r.integers(0, 3000, 1_000_000) // r.integers(1, 300, 1_000_000), 0).astype(np.uint32)
    before, after = phrase_index.PhraseIndex.transforms(ids, 6)
    tracemalloc.start()
    held = phrase_index.PhraseIndex(before, after)
    pairs = held.longer(held.single(), keep=lambda x: x.count >= 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(ids)
    whole = held.longer(held.single(), step=10**9)
    whole = whole[whole.count >= 100]
    small = held.longer(held.single(), keep=lambda x: x.count >= 100, step=7)
    for name in ("words", "low", "back", "count"):
        assert (getattr(pairs, name) == getattr(whole, name)).all() and (getattr(small, name) == getattr(whole, name)).all()
    none = held.longer(held.single()[:0])
    assert none.words.shape == (0, 2) and len(none.count) == 0
