"""The queries against their SQL, and the pipeline against its stages."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rollbook.llm import compression_quality, decontaminate, language_bayes, mixing, queries, secret_index, simhash, token_blocks
from tests.llm import messy
from tests.parity import DATA, compare, connect

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect("0.01"), name, "0.01") == ""


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if not n.startswith("op12_")])  # op12 has a row a phrase
def test_query_has_a_row_for_every_document(spark, name):
    table = "embeddings" if name.startswith("op1_") else "documents"
    key = "vec_id" if table == "embeddings" else "doc_id"
    got = queries.QUERIES[name](spark, SF).select(key)
    want = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "source_mix", "token_files"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        before, after = ({(r["doc_id"], r["text"]) for r in x.collect()} for x in (docs, out))
        assert after <= before
        if name == "decontamination":
            hit = {r["doc_id"] for r in queries.op6_benchmark_decontamination(spark, SF).where("contaminated").collect()}
            assert after == {x for x in before if x[0] not in hit}
        docs = spark.createDataFrame(out.collect(), out.schema)
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(r["doc_id"] for r in ran.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_of_each_pipeline_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def quality(docs):
        scored = compression_quality.score(docs, queries.quality_model(spark, SF), keep=["doc_id", "text"]).collect()
        return Counter((r["doc_id"], r["text"]) for r in scored if r["score"] >= 0.7)

    def near_duplicates(docs):
        prints = [(r["doc_id"], r["text"], r[2] % 2**64) for r in simhash.fingerprints(docs, keep=["doc_id", "text"], shingle=3).collect()]
        left, out = sorted(prints), Counter()
        while left:
            group, todo = [], [left[0]]
            left = left[1:]
            while todo:
                group.append(todo.pop())
                near = [x for x in left if (x[2] ^ group[-1][2]).bit_count() <= 3]
                todo += near
                left = [x for x in left if x not in near]
            out[min(group)[:2]] += 1
        return out

    def decontamination(docs):
        found = decontaminate.matches(docs, queries.read_benchmark(spark, SF), keep=["doc_id", "text"], window=10).collect()
        return Counter((r["doc_id"], r["text"]) for r in found if not r["n_hit"])

    def source_mix(docs):
        texts, out = {r["doc_id"]: r["text"] for r in docs.collect()}, Counter()
        for r in mixing.plan(docs, weights=(5, 2, 1), share=1.5, most=2.0).collect():
            more = r["taken"] - r["epochs"] * r["size"]
            out[r["doc_id"], texts[r["doc_id"]]] += r["epochs"] + int(r["size"] > 0 and 2 * more >= r["size"])
        return +out

    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (quality, near_duplicates, decontamination, source_mix), strict=True):
        out = stage(spark, docs, SF)
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert got and got == plain(docs), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    whole, want, start = Tokenizer.from_file(queries.TOKENIZER), Counter(), 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_redaction_counts_are_those_of_the_redacted_texts(spark):
    whole = Tokenizer.from_file(queries.TOKENIZER)
    texts = {r["doc_id"]: r["text"] or "" for r in queries.read_documents(spark, SF).collect()}
    got = queries.op2_edit_token_counts(spark, SF).collect()
    assert sum(r["n_edits"] for r in got) > 20
    for r in got:
        redacted = re.sub(queries.PERSONAL.pattern, "[personal]", texts[r["doc_id"]])
        assert r["n_edits"] == len(re.findall(queries.PERSONAL.pattern, texts[r["doc_id"]]))
        assert r["n_tokens"] == len(whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert r["n_tokens_after"] == len(whole.encode(redacted, add_special_tokens=False).ids)
        assert r["n_chars_after"] == len(redacted)


def test_quality_scores_from_the_sizes(spark):
    model = queries.quality_model(spark, SF)
    packers = [zstandard.ZstdCompressor(
        level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False
    ) for d in (model.good, model.bad)]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in queries.read_documents(spark, SF).collect()}
    for r in queries.op7_compression_quality(spark, SF).collect():
        text = texts[r["doc_id"]]
        want = model.prior
        if text:
            small, large = (sum(len(p.compress(text[i : i + model.piece])) for i in range(0, len(text), model.piece)) for p in packers)
            share = small / len(text)
            x = float(np.dot(model.curve, [1, (large - small) / (large + small), share, share * share]))
            want = 1 / (1 + np.exp(-x))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.7)


def plain_features(text: str, bits: int, orders: tuple[int, ...]):
    padded = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    for order in orders:
        for i in range(len(padded) - order + 1):
            key = order * 0x27D4EB2F & 0xFFFFFFFF
            for j in range(order):
                key = (key ^ ord(padded[i + j])) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[j % 3] & 0xFFFFFFFF
                key ^= key >> 15
            yield key >> 32 - bits


def test_languages_by_hand(spark):
    """Counts, predictions and scores from plain dictionaries."""
    docs = [(r["doc_id"], r["text"] or "", r["lang"]) for r in queries.read_documents(spark, SF).collect()]
    learn = [x for x in docs if x[2] and zlib.crc32(str(x[0]).encode()) % 5 and any(unicodedata.category(c)[0] == "L" for c in x[1])]
    counts, number = {}, Counter(x[2] for x in learn)
    for _, text, lang in learn:
        counts.setdefault(lang, Counter()).update(plain_features(text, 16, (1, 2, 3)))
    total = {lang: sum(c.values()) + 0.5 * 65536 for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    for doc_id, text, _ in docs[:120]:
        if not any(unicodedata.category(c)[0] == "L" for c in text):
            assert got[doc_id]["lang_pred"] == "und" and got[doc_id]["score"] == 0
            continue
        own = Counter(plain_features(text, 16, (1, 2, 3)))
        logs = {
            lang: sum(n * np.log((c[f] + 0.5) / total[lang]) for f, n in own.items()) / 3 + np.log(number[lang] / len(learn))
            for lang, c in counts.items()
        }
        best = max(sorted(logs), key=logs.get)
        assert got[doc_id]["lang_pred"] == best
        assert got[doc_id]["score"] == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_digits_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "²½ ①"), (2, "Ⅷ 12"), (3, "ß"), (4, "_")], "doc_id long, text string")
    model = language_bayes.LanguageModel(["de"], np.zeros(1), np.zeros((1 << 16, 1), np.float32), 16, (1, 2, 3))
    got = {r["doc_id"]: r["lang_pred"] for r in language_bayes.predict(docs, model, keep=["doc_id"]).collect()}
    assert got == {1: "und", 2: "und", 3: "de", 4: "und"}


def test_a_text_with_very_many_secrets(spark):
    rule = secret_index.BASE_RULES[0]
    text = " é🙂 ".join(f"token={i:08d}" + ("" if i % 3 else " password: x") for i in range(100_000))
    got = spark.createDataFrame([(text,), ("",)], "t string").select(secret_index.spans(F.col("t"), rule).alias("s")).collect()
    want = [(m.start(), m.end()) for m in re.finditer(rule.pattern, text) if len(m[2]) >= 8]
    assert sorted(((x["start"], x["end"]) for x in got[0]["s"]), key=lambda x: x[0]) == want and got[1]["s"] == []


def test_block_files_refuse_folders_that_tasks_cannot_open(spark):
    assert token_blocks.reachable(spark, "/tmp/x/y") == "file:///tmp/x/y"
    assert token_blocks.reachable(spark, "file:/tmp/x") == "file:///tmp/x"
    with pytest.raises(ValueError, match="cannot be written"):
        token_blocks.reachable(spark, "wasbs://box@somewhere/x")


def test_a_tokenizer_that_joins_words_gets_whole_texts(tmp_path):
    """One whose tokens reach over spaces."""
    from tokenizers import models, pre_tokenizers

    joined = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4, "\n": 5}, merges=[("a", " "), ("a ", "b")], unk_token="a"))
    joined.pre_tokenizer = pre_tokenizers.Split("|", "isolated")
    joined.save(str(tmp_path / "joined.json"))
    encoder = token_blocks.WordEncoder(str(tmp_path / "joined.json"))
    texts = ["a b", "a b\na b", "b a b a", ""]
    assert not encoder.cuts
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [joined.encode(t).ids for t in texts]
    assert token_blocks.WordEncoder(queries.TOKENIZER).cuts


def test_pipeline_of_messy_documents(spark, tmp_path):
    docs = messy.documents(spark).where("doc_id IS NULL OR doc_id < 200")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "CAST(doc_id % 4 > 0 AS INT) AS quality", "0 AS toxic").distinct().write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", messy.prose(105, 30)), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = queries.read_documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == docs.columns and out.count() <= 2 * rows.count(), name
    kept = corpus_pipeline.STAGES[1][1](spark, rows, folder).collect()
    assert len({(r["doc_id"], r["text"]) for r in kept}) == len(kept) and "__copy" in out.columns
    assert corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() == rows.count()
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
