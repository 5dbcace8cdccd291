"""What the operators share: staged tables and per-text work in Arrow batches."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.session import run_dir

#: A scorer takes the column of texts of one batch and returns one Arrow array for each new column.
Scorer = Callable[[pa.Array], list[pa.Array]]


def named(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes to be no column of the frame."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, so a lost executor costs no earlier stage."""
    path = run_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs, which it does once the driver has collected its garbage."""
    gc.collect()
    for _ in range(3):  # what the first collection finds is let go of by the next
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Bytes of text that one step of a task holds as Python objects; a longer text is alone in its step.
SLICE_BYTES = 2_000_000


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, stop
        at = stop


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def as_text(texts: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [x or "" for x in texts.to_pylist()]


def per_text(
    df: DataFrame, text: str, keep: list[str], added: list[T.StructField], make: Callable[[], Scorer]
) -> DataFrame:
    """``keep`` and the ``added`` columns, computed from the text of each row without a shuffle.

    ``make`` runs once in a task; a step of it gets texts of bounded size. A kept column with the name of an added one is replaced.
    """
    new = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name in keep and f.name not in new]
    fields = [*kept, *added]
    plain = _numbered(fields)
    source = df.select(*(named(f.name).alias(f"c{i}") for i, f in enumerate(kept)), named(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for at, stop in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, stop - at)
                columns = score(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=plain.names)

    return source.mapInArrow(run, plain).toDF(*(f.name for f in fields))


def _numbered(fields: list[T.StructField]) -> T.StructType:
    """The same fields as c0, c1, ...: Spark's Python operators take no dots in names."""
    return T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(fields)])


def filter_by_text(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows for whose text the mask is true, all columns as they are, without a shuffle."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = make()
        for batch in batches:
            for first, stop in slices(batch.column(at)):
                part = batch.slice(first, stop - first)
                yield part.filter(mask(part.column(at)))

    plain = _numbered(df.schema.fields)
    return df.toDF(*plain.names).mapInArrow(run, plain).toDF(*df.columns)


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds
