"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm import (
    backoff_lm,
    compression_quality,
    decontaminate,
    language_bayes,
    mixing,
    periodic_runs,
    phrase_index,
    secret_index,
    simhash,
    sql,
    subspace_join,
    suffix_dedup,
    token_blocks,
    token_edits,
)
from rollbook.llm.common import crc_fold, staged
from rollbook.sources.readers import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark")


def op1_subspace_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whatever their labels, linked at cosine 0.95."""
    found = subspace_join.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)
    return found.withColumnRenamed("component", "component_id")


#: What op2 redacts: mail addresses, and runs of digits that may be phone, card or network numbers.
PERSONAL = secret_index.Rule("personal", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\+?[0-9][0-9 ().-]{5,}[0-9]", 0, 0)


def op2_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its personal data are redacted, counted by its segment tree."""
    trees = token_edits.build_trees(read_documents(spark, sf_dir), TOKENIZER, keep=["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    edits = F.transform(
        secret_index.spans(text, PERSONAL), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[personal]").alias("text"))
    )
    return token_edits.apply_edits(staged(trees, "trees"), TOKENIZER, F.when(text.rlike(PERSONAL.pattern), edits))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three words, linked at three bits or fewer; a null doc_id names no group."""
    found = simhash.near_duplicates(read_documents(spark, sf_dir), shingle=3, radius=3)
    return found.select("doc_id", "fingerprint", F.col("component").alias("component_id"))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as ids with id 2 behind each, written to block files and read back."""
    return token_blocks.round_trip(read_documents(spark, sf_dir), TOKENIZER, end_id=2)


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the word pair counts of all documents of the other fold."""
    return backoff_lm.score(read_documents(spark, sf_dir))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a ten-word window of a benchmark item."""
    found = decontaminate.matches(
        read_documents(spark, sf_dir), read_benchmark(spark, sf_dir), keep=["doc_id"], window=10
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def quality_model(spark: SparkSession, sf_dir: str) -> compression_quality.CompressionModel:
    """Learnt from the labelled documents outside fold 2 of 4."""
    learn = read_documents(spark, sf_dir).where(crc_fold(F.col("doc_id"), 4) != 2)
    labels = _table(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id"), 4) != 2)
    return compression_quality.fit(learn, labels, label="quality")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that a text is of quality 1; a null doc_id is in no fold and counts as not held out."""
    found = compression_quality.score(read_documents(spark, sf_dir), quality_model(spark, sf_dir), keep=["doc_id"])
    held = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn and share 150% of all words, at most twice their own."""
    found = mixing.plan(read_documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0)
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the documents outside fold 0 of 5; a null doc_id is in no fold and teaches nothing."""
    docs = read_documents(spark, sf_dir)
    fold = crc_fold(F.col("doc_id"), 5)
    model = language_bayes.fit(docs.where(fold != 0))
    found = language_bayes.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base kinds and what the scan adds, over whole texts."""
    found = secret_index.scan(read_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``: where the contract plants a periodic tail, the words with that tail, joined by a space."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every text; a null doc_id gets no planted tail."""
    found = periodic_runs.detect(periodic_tails(read_documents(spark, sf_dir)), keep=["doc_id"])
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), periodic_runs.longest(F.col("runs")).alias("best"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language, of 2 to 5 words that occur 100 times and more."""
    found = phrase_index.collocations(read_documents(spark, sf_dir), depth=5, least=100)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(order)).where("rank <= 2000")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its strings of 50 bytes that a document of a smaller doc_id holds."""
    found = suffix_dedup.remove_repeats(read_documents(spark, sf_dir), keep=["doc_id"], length=50)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_subspace_near_dedup": op1_subspace_near_dedup,
    "op2_edit_token_counts": op2_edit_token_counts,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_token_blocks": op4_token_blocks,
    "op5_backoff_scores": op5_backoff_scores,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_compression_quality": op7_compression_quality,
    "op8_source_mixing": op8_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
}
SQL = {
    "op1_subspace_near_dedup": sql.EMBEDDINGS,
    "op6_benchmark_decontamination": sql.BENCHMARK,
    "op8_source_mixing": sql.MIX,
    "op10_secret_scan": sql.SECRETS,
    "op12_phrase_collocations": sql.PHRASES,
}
