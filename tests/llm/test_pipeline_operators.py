"""The operators of the pipeline, against brute force and on awkward tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from rollbook.llm import compression_quality, decontaminate, mixing, simhash, token_blocks
from rollbook.llm.components import components
from tests.llm import messy

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- components

def test_components_of_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 1 for i in range(1, 41))
    assert all(got[i] == 100 for i in range(100, 140))
    assert got[202] == got[201] == got[200] == 200


def test_components_of_nothing(spark):
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


# ---- SimHash

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("source", ["messy", "real"])
def test_near_duplicates_match_all_pairs(spark, source):
    docs = messy.documents(spark) if source == "messy" else real(spark)
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    n = len(rows)
    group = union(n, [(i, j) for i in range(n) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3])
    least = {}
    for (key, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), key) if x is not None), default=None)
    want = Counter((key, f"{fp:016x}", least[g]) for (key, fp), g in zip(rows, group, strict=True))
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component")
    assert Counter(rows_of(got)) == want


def test_links_cross_blocks_and_split_shards(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    values = {base}
    while len(values) < 300:  # one crowded ball, so shards exceed the tree size
        values.add(base ^ sum(1 << b for b in r.sample(range(20), r.randint(1, 4))))
    values |= {r.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    at = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
    for tree_rows in (4096, 16):
        found = [(at[a], at[b]) for a, b in rows_of(simhash.links(frame, radius=3, tree_rows=tree_rows))]
        assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in found)
        assert union(len(values), found) == union(len(values), pairs)


def test_tree_search_finds_what_a_scan_finds():
    r = random.Random(1)
    tree, values = simhash.BKTree(), [r.getrandbits(12) for _ in range(500)]
    for v in values:
        tree.add(v)
    for radius in (0, 1, 3):
        for q in values[:50]:
            assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def test_one_document_of_each_group_stays(spark):
    docs = messy.documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(r["text"]) for r in kept.collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    every = {plain_fingerprint(r["text"]) for r in docs.collect()}
    assert len(prints) == len(set(union(len(every), [
        (i, j) for i, a in enumerate(sorted(every)) for j, b in enumerate(sorted(every)) if j < i and (a ^ b).bit_count() <= 3
    ])))
    assert simhash.keep_one(messy.empty(spark)).count() == 0
    assert simhash.near_duplicates(messy.empty(spark)).count() == 0


# ---- decontamination

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_matches(text, bench, window=10):
    words, hit, items, longest = plain_words(text), set(), set(), 0
    for item, other in bench:
        w = plain_words(other)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    hit.update(range(i, i + n))
                    items.add("null" if item is None else str(item))
                    k = n
                    while i + k < len(words) and j + k < len(w) and words[i + k] == w[j + k]:
                        k += 1
                    longest = max(longest, k)
    return len(words), len(hit), sorted(items), longest


@pytest.mark.parametrize("blocks", [1 << 30, 50])
def test_matches_brute_force(spark, blocks):
    bench = [(1, messy.prose(100, 12)), (2, "Beta, GAMMA!"), (10, messy.prose(101, 33)[5:]), (None, "one"), (3, None), (4, ""), (5, messy.prose(101, 33)), (5, "zz top")]
    table = spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, items string")
    docs = messy.documents(spark)
    extra = messy.documents(spark, [(77, "the beta gamma and beta gamma ONE " + messy.prose(101, 33) + " zz-top", "en", "s")])
    docs = docs.unionByName(extra)
    got = decontaminate.matches(docs, table, keep=["doc_id", "n_chars"], block_chars=blocks, shard_docs=7)
    want = Counter((r["doc_id"], r["n_chars"], *((n, h, tuple(i), g) if True else ())) for r in docs.collect() for n, h, i, g in [plain_matches(r["text"], bench)])
    found = got.collect()
    assert Counter((r[0], r[1], r[2], r[3], tuple(r[4]), r["longest"]) for r in found) == want
    for r in found:
        assert (r["longest_at"] >= 0) == (r["longest"] > 0)
    kept = decontaminate.clean(docs, table, block_chars=blocks)
    assert kept.columns == docs.columns
    assert sorted(map(str, rows_of(kept.select("doc_id", "text")))) == sorted(
        str((r["doc_id"], r["text"])) for r in docs.collect() if not plain_matches(r["text"], bench)[1]
    )


def test_one_block_of_the_benchmark_is_held_at_a_time(spark, monkeypatch):
    held, most = [], []
    context = type(spark.sparkContext)
    put, drop = context.broadcast, decontaminate.Broadcast.destroy

    def broadcast(self, value):
        held.append(1)
        most.append(len(held))
        return put(self, value)

    monkeypatch.setattr(context, "broadcast", broadcast)
    monkeypatch.setattr(decontaminate.Broadcast, "destroy", lambda self, *a, **b: (held.pop(), drop(self, *a, **b))[1])
    bench = spark.createDataFrame([(i, messy.prose(100 + i, 20)) for i in range(4)], "item_id long, text string")
    for run in (lambda: decontaminate.matches(messy.documents(spark), bench, keep=["doc_id"], block_chars=150), lambda: decontaminate.clean(messy.documents(spark), bench, block_chars=150)):
        held.clear()
        most.clear()
        assert run().count() and len(most) > 2 and max(most) == 1


def test_matches_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(messy.documents(spark), none).count() == messy.documents(spark).count()
    assert decontaminate.matches(messy.empty(spark), none, keep=["doc_id"]).count() == 0


# ---- quality

def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = compression_quality.fit(docs.where(~held), labels.where(~held))
    got = compression_quality.score(docs.where(held).join(labels, "doc_id"), model, keep=["label"]).toPandas()
    good, bad = got.score[got.label == 1].to_numpy(), got.score[got.label == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (good >= 0.7).mean() > 0.98 and (bad >= 0.7).mean() < 0.2
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_quality_on_awkward_tables(spark):
    docs = messy.documents(spark)
    labels = docs.select("doc_id", F.lit("x").alias("text"), (F.col("doc_id") % 2).alias("label"))
    none = compression_quality.fit(docs, labels.withColumn("label", F.lit(None).cast("int")))
    assert {r["score"] for r in compression_quality.score(docs, none, keep=["doc_id"]).collect()} == {0.5}
    few = compression_quality.fit(docs, labels)
    scored = compression_quality.score(docs, few, keep=["doc_id", "text"])
    assert scored.count() == docs.count() and scored.columns == ["doc_id", "text", "score"]
    by_text = {}
    for r in scored.collect():
        assert 0 <= r["score"] <= 1
        assert by_text.setdefault(r["text"], r["score"]) == r["score"]
    assert by_text[None] == by_text[""] == few.prior
    assert compression_quality.keep_good(docs, few, threshold=0.0).count() == docs.count()
    assert compression_quality.score(messy.empty(spark), few, keep=["doc_id"]).count() == 0


# ---- mixing

def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        each = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if each[s] > most * sizes[s]}
        if not above:
            return target | each
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= above
    return target


@pytest.mark.parametrize("source", ["messy", "real"])
def test_mix_matches_brute_force(spark, source):
    docs = messy.documents(spark) if source == "messy" else real(spark)
    got = mixing.plan(docs, buckets=4).toPandas()
    assert len(got) == docs.count()
    data = docs.collect()
    sizes = Counter()
    for r in data:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = plain_targets(sizes)
    for name, part in got.groupby("source", dropna=False):
        name = None if name != name or name is None else name
        assert set(part.source_size) == {sizes[name]}
        assert part.target.iloc[0] == pytest.approx(want[name])
        assert abs(part.taken.sum() - want[name]) <= 1
        assert (part.taken <= 2 * part["size"]).all() and (part.taken >= part.epochs * part["size"]).all()
        full, partly = part[part.taken > part.epochs * part["size"]], part[part.taken == part.epochs * part["size"]]
        partly = partly[partly["size"] > 0]
        if len(full) and len(partly):  # who is taken once more waits no longer than who is not
            waits = {(r[0], r[1]): r[2] for r in docs.select("doc_id", mixing.size_of(F.col("text")), mixing.sample_key(F.col("doc_id"), F.col("text"), mixing.letter_share(F.col("text")), 7)).collect()}
            key = lambda f: [waits[(None if d != d else int(d), s)] for d, s in zip(f.doc_id, f["size"], strict=True)]
            assert max(key(full)) <= min(key(partly))


def test_heavier_documents_come_earlier(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two' AS text", "'s' AS source", "IF(id % 2 = 0, 4.0, 1.0) AS w")
    docs = docs.unionByName(spark.range(1).selectExpr("id - 1", "repeat('x ', 6000)", "'t'", "1.0D").toDF("doc_id", "text", "source", "w"))
    plan = mixing.plan(docs, weight=F.col("w"), weights=(1, 9), share=0.9, most=1.0).where("source = 's'")
    taken = plan.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).toPandas().set_index("odd").n
    assert taken[0] > 1.05 * taken[1]
    assert taken.sum() == pytest.approx(plan.first()["target"], abs=1)


def test_mix_returns_whole_documents(spark):
    docs = messy.documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    plan = mixing.plan(docs).collect()
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    rows = Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    assert set(times) <= set(rows) and all(times[k] <= 2 * rows[k] for k in times)
    words = sum(len((k[1] or "").split()) * n for k, n in times.items())
    assert abs(words - sum(r["taken"] for r in plan)) <= sum(max(r["size"] for r in plan if r["source"] == s) for s in {r["source"] for r in plan})
    assert mixing.mix(messy.empty(spark)).count() == 0 and mixing.plan(messy.empty(spark)).count() == 0


def test_light_documents_spread_over_the_buckets(spark):
    n, buckets = 50_000, 1024
    for weight in (0.05, 1.0, 30.0):
        waiting = mixing.sample_key(F.col("id"), F.lit("x"), F.lit(weight), 7)
        sizes = spark.range(n).groupBy(mixing.bucket_of(waiting, buckets)).count()
        assert sizes.agg(F.max("count")).first()[0] < 3 * n / buckets


def test_repeated_rows_are_taken_one_by_one(spark):
    rows = [(1, "a b c", "s")] * 500 + [(i, "d e", "s") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.plan(docs, weights=(1,), share=0.5, most=1.0).collect()
    assert sorted((x["doc_id"], x["size"]) for x in got) == sorted((k, len(t.split())) for k, t, _ in rows)
    assert sum(x["taken"] for x in got) == int(got[0]["target"])
    # at most one document is taken in part
    assert sum(0 < x["taken"] < x["size"] for x in got) <= 1


# ---- token blocks

@pytest.mark.parametrize("block", [4, 128, 1024])
def test_blocks_round_trip(block):
    r = np.random.default_rng(3)
    for ids in (
        np.zeros(0, np.uint32), np.array([7]), np.full(1000, 5), r.integers(0, 50_257, 5000), r.integers(0, 2**32, 3000),
        np.where(r.random(4097) < 0.02, 2**32 - 1, r.integers(0, 30, 4097)),
    ):
        ids = ids.astype(np.uint32)
        held = token_blocks.BlockFile(token_blocks.encode_ids(ids, np.array([len(ids)]), [None], block))
        assert (held.ids() == ids).all() and held.keys == [None]
        for a, b in ((0, 1), (3, 9), (len(ids) // 2, len(ids)), (block, 2 * block + 1)):
            assert (held.ids(a, b) == ids[a:b]).all()


def test_blocks_are_smaller_than_their_widest_id():
    ids = np.where(np.arange(102_400) % 97 == 0, 50_000, np.arange(102_400) % 50).astype(np.uint32)
    assert len(token_blocks.encode_ids(ids, np.array([len(ids)]), [1])) < len(ids) * 1.1


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    encoder = token_blocks.WordEncoder(TOKENIZER, room=300)
    r = random.Random(2)
    cases = [t or "" for t in messy.texts()]
    cases += ["".join(r.choice([" ", "  ", "\n", "\t", "a", "B", "é", "1", ".", "'s", "'", " ", "🙂", "\x1c", "\x85", "​"]) for _ in range(60)) for _ in range(400)]
    for text, body in zip(cases, encoder.encode(cases), strict=True):
        assert np.frombuffer(body, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    few = token_blocks.WordEncoder(TOKENIZER, room=60)  # forgets between calls
    parts = [b for at in range(0, len(cases), 3) for b in few.encode(cases[at : at + 3])]
    assert parts == encoder.encode(cases) and few.older


@pytest.mark.parametrize("source", ["messy", "real"])
def test_token_files_match_the_library(spark, source):
    from tokenizers import Tokenizer

    docs = messy.documents(spark) if source == "messy" else real(spark)
    got = token_blocks.round_trip(docs, TOKENIZER, file_ids=5000).collect()
    whole = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    start, last = 0, -1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and (r["doc_id"] is None or r["doc_id"] >= last)
        start, last = start + r["n_tokens"], last if r["doc_id"] is None else r["doc_id"]
    assert token_blocks.round_trip(messy.empty(spark), TOKENIZER).count() == 0


