"""Periodic runs against a search of all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rollbook.llm import periodic_runs, queries
from tests.llm import messy


def brute(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of all maximal runs, by start, then period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                found.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    out = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in out)


def sequences(r: random.Random) -> list[list[int]]:
    docs = []
    for _ in range(r.randint(1, 4)):
        kind = r.randint(0, 4)
        if kind == 0:
            docs.append([r.randint(0, 1) for _ in range(r.randint(0, 120))])
        elif kind == 1:
            d: list[int] = []
            for _ in range(r.randint(1, 6)):
                d += [r.randint(0, 5) for _ in range(r.randint(1, 25))] * r.randint(1, 6)
                d = d[: len(d) - r.randint(0, 3)]
            docs.append(d)
        elif kind == 2:
            docs.append([0] * r.randint(0, 70))
        elif kind == 3:
            a, b = [0], [0, 1]
            for _ in range(r.randint(1, 9)):
                a, b = b, b + a
            docs.append(b)
        else:
            d = [r.randint(0, 50) for _ in range(100)]
            docs.append(d + d[20:70] + d[20:70] + d[20:60])
    return docs


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_sequences(seed):
    r = random.Random(seed)
    for _ in range(10):
        docs = sequences(r)
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        start, end, period = periodic_runs.runs_of(ids, doc)
        want, at = [], 0
        for d in docs:
            want += [(s + at, n, p) for s, n, p in brute(d)]
            at += len(d)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == want


def test_grammar_derives_its_sequence():
    sequence = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 4, 4, 4, 4, -1, 1, 2, 3, 9, -2, 4, 4, 4])
    grammar = periodic_runs.Grammar.repair(sequence)
    for owner, place in zip(grammar.owners, grammar.places, strict=True):
        first, n = grammar.place[owner], grammar.length[owner]
        assert (sequence[place : place + n] == sequence[first : first + n]).all()
        assert (sequence[first : first + n] >= 0).all() and 0 < grammar.left[owner] < n
    # a stretch is one nonterminal in the end
    assert {(0, 13), (14, 4), (19, 3)} <= set(zip(grammar.places, grammar.length[grammar.owners], strict=True))


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_detect_on_awkward_rows(spark):
    loop = "na na na batman " * 5000
    rows = [(1, loop, "en", "s"), (2, " ".join(["x"] * 12), None, None), (3, " ".join(["x"] * 11), None, None)]
    rows += [tuple(r[:4]) for r in messy.documents(spark).collect()]
    docs = messy.documents(spark, rows).withColumnRenamed("k", "runs")
    got = periodic_runs.detect(docs, keep=["doc_id", "text", "runs", "a.b"])
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        words = words_of(r["text"])
        runs = [tuple(x) for x in r["runs"]]
        if len(words) < 15_000:  # all periods of longer ones take too long
            assert runs == brute(words), r["doc_id"]
        assert r["collapsed"] == collapsed(words, runs) and r["n_words"] == len(words)
        if r["text"] == loop:
            assert runs == [(0, 20_000, 4)]
    assert periodic_runs.detect(messy.empty(spark), keep=["doc_id"]).count() == 0


def test_query(spark):
    got = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    docs = queries.read_documents(spark, "/root/testdata/sf0.001").collect()
    want = []
    for d in docs:
        words = planted(d["doc_id"], words_of(d["text"]))
        if len(words) > 4000:
            continue
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((
            d["doc_id"], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        ))
    known = {w[0] for w in want}
    assert len(known) > 150 and sum(w[1] for w in want) > 15
    assert sorted(tuple(r) for r in got if r["doc_id"] in known) == sorted(want)
    assert len(got) == len(docs)
