"""A training corpus from raw documents: quality, near duplicates, benchmark passages, mixing, token files.

Each stage reads what the one before it kept, written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import compression_quality, decontaminate, mixing, simhash, token_blocks
from rollbook.llm.queries import TOKENIZER, quality_model, read_benchmark, read_documents
from rollbook.session import run_dir

#: SQL for the rows of run(): none, the classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more."""
    return compression_quality.keep_good(docs, quality_model(spark, sf_dir), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints (three words) that three bits or fewer link."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.clean(docs, read_benchmark(spark, sf_dir), window=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 in turn, 150% of all words, twice at most."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in block files in doc_id order, with id 2 behind each document; what the files hold, read back."""
    # a worker of the pipeline holds what other stages left, too
    return token_blocks.round_trip(docs, TOKENIZER, end_id=2, room=120_000_000)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("source_mix", source_mix), ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table: one row per document of the mix, as the token files hold it.

    Null and empty texts get the share of good labels as their score and, where they stay, are one group of near duplicates
    without words. Rows of one key and text are one after the second stage; the mix may then take a document twice. A null
    key comes first in the files. Other columns, whatever their names, go through all stages but the last, which returns
    counts. An empty table gives no rows.
    """
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        path = run_dir(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
