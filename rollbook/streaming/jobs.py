"""Streaming jobs over the change log.

Each reads a folder of change files and runs until what is there is consumed
(``availableNow``), or continuously when a trigger interval is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rollbook.sinks.writers import remove_path, upsert_months


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    glob: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """The files of a table as a stream: ``path`` is its folder or its only file. A path without files is an error,
    as a stream over it would end without having written anything."""
    files = spark.read.schema(schema).option("pathGlobFilter", glob).parquet(path).inputFiles()
    if not files:
        raise FileNotFoundError(f"no file {glob} in {path}")
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # streams read folders only
        path, glob = folder, name
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def run(writer, interval: str | None = None) -> StreamingQuery:
    """Start a query; without an interval wait until everything available is consumed."""
    if interval is not None:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def apply_changes(
    changes: DataFrame,
    table: str,
    checkpoint: str,
    keys: Sequence[str] = ("student_id", "date", "subject"),
    order: Sequence[str] = ("updated_at", "id"),
    interval: str | None = None,
) -> StreamingQuery:
    """Keep ``table`` at the last write per key, NULL subjects being one key.

    The last write is decided by the changes' own time and number, not by arrival, so
    late, repeated and reordered batches end in the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # numbers start again with a new checkpoint, so a batch is named by the query's id too
        query_id = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        upsert_months(spark, table, batch, keys, order, f"{query_id}-{batch_id}")
        remove_path(spark, f"{table}.staging/{query_id}-{batch_id - 1}")

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return run(writer, interval)


def drop_repeats(
    changes: DataFrame, key: str, event_time: str, delay: str, spread: Column | None = None
) -> DataFrame:
    """Drop retried changes that arrive within the delay of the first.

    ``spread`` (a small number that differs between the copies of one key) makes a first
    pass per part of a key, so that one change retried very often is not one task.
    """
    marked = changes.withWatermark(event_time, delay)
    if spread is not None:
        marked = marked.withColumn("_spread", spread).dropDuplicatesWithinWatermark([key, "_spread"])
        marked = marked.drop("_spread")
    return marked.dropDuplicatesWithinWatermark([key])


def daily_status(changes: DataFrame, event_time: str = "updated_at", delay: str = "1 hour") -> DataFrame:
    """Changes per day and status; a day is emitted once, when the watermark has passed it."""
    counted = (
        changes.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 day"), "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(F.to_date("window.start").alias("day"), "status", "n")


def append_to(rows: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    return run(writer.option("checkpointLocation", checkpoint), interval)


def undoable(table: DataFrame, as_of: Column, minutes: int = 30, delete_flag: str = "is_delete") -> DataFrame:
    """Deletes of the current table that are younger than the undo window."""
    recent = F.col("updated_at") >= as_of - F.make_dt_interval(mins=F.lit(minutes))
    return table.filter(F.col(delete_flag) & recent)
