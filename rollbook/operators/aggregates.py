"""Shared aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.common import col
from rollbook.operators.joins import null_safe_join
from rollbook.operators.ordering import with_position
from rollbook.schema import STATUSES
from rollbook.session import run_dir


def tally(statuses: Sequence[str] = STATUSES, status="status") -> list[Column]:
    """One filtered count per status, named ``<status>_count``."""
    return [F.count_if(col(status) == s).alias(f"{s}_count") for s in statuses]


def tally_with_unmarked(status="status") -> list[Column]:
    """Counts per status, of rows without a known status, and of all rows."""
    unmarked = F.coalesce(~col(status).isin(*STATUSES), F.lit(True))
    return [
        *tally(status=status),
        F.count_if(unmarked).alias("unmarked_count"),
        F.count(F.lit(1)).alias("total_count"),
    ]


def currency_summary(rows: DataFrame, amount: str, classes: str, copies: str | None = None) -> DataFrame:
    """Per currency: rows, classes, and the total, paid and unpaid amounts with their counts.

    Unpaid counts only amounts above zero. One more row (``is_total``) covers everything;
    it has counts but no amounts, since currencies do not add up. ``copies`` weighs each
    row by a multiplicity.
    """
    n = F.col(copies).cast("decimal(19,0)") if copies else F.lit(1).cast("decimal(19,0)")
    paid = F.col("paid")
    unpaid = ~F.col("paid") & (F.col(amount) > 0)
    worth = F.col(amount) * n

    def count_of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)).cast("long"), F.lit(0))

    def money(condition: Column) -> Column:
        total = F.coalesce(F.sum(F.when(condition, worth)), F.lit(0)).cast("double")
        return F.when(F.grouping("currency") == 0, total)

    return rows.groupingSets([["currency"], []], "currency").agg(
        (F.grouping("currency") == 1).alias("is_total"),
        count_of(F.lit(True)).alias("n_rows"),
        F.sum(F.col(classes) * n).cast("long").alias("n_classes"),
        money(F.lit(True)).alias("total"),
        money(paid).alias("paid"),
        money(unpaid).alias("unpaid"),
        count_of(paid).alias("paid_count"),
        count_of(unpaid).alias("unpaid_count"),
    )


def pivot_days(cells: DataFrame, keys: Sequence[str], value: str, day: str = "day") -> DataFrame:
    """One column per day of the month; the day list is given, so no extra job finds it."""
    wide = cells.groupBy(*keys).pivot(day, list(range(1, 32))).agg(F.max(value))
    return wide.withColumnsRenamed({str(d): f"d{d:02d}" for d in range(1, 32)})


def nested_groups(
    rows: DataFrame, keys: Sequence[str], bucket: Sequence[str], name: str, fields: Sequence[str]
) -> DataFrame:
    """Rows nested under a key as sorted arrays, one array per key and bucket.

    ``bucket`` keeps every array short: a key with very many rows is written as several
    array rows next to each other instead of one huge value.
    """
    items = F.sort_array(F.collect_list(F.struct(*fields)))
    return rows.groupBy(*keys, *bucket).agg(F.count(F.lit(1)).alias("n_items"), items.alias(name))


def chunked_groups(
    rows: DataFrame, keys: Sequence[str], name: str, fields: Sequence[str], length: int = 1000, tasks: int | None = None,
    hot: int = 10_000,
) -> DataFrame:
    """Rows nested under a key as arrays of at most ``length``: per key and ``chunk`` (from 0) the array, sorted by its
    fields, with ``n_items`` of the whole key.

    The rows are written once. A key of up to ``hot`` rows is gathered, sorted and cut where its rows meet. The others
    take their places from one sort of all their rows by many tasks (``tasks``, the session's number without it), so a key
    with any number of rows is cut without being gathered. A hash stands before the key: numbers are compared in place
    of texts that begin alike, and keys of one hash are still told apart.
    """
    grouped = ["_key", *keys]
    hashed = rows.select(F.xxhash64(*keys).alias("_key"), *keys, *fields)
    path = run_dir(rows.sparkSession, "groups")
    hashed.write.parquet(path)
    held = rows.sparkSession.read.schema(hashed.schema).parquet(path)
    large = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("_key")
    if large.isEmpty():
        return _chunks_of_small(held, grouped, name, fields, length)
    large = F.broadcast(large)  # a row for every ``hot`` rows at most
    small = _chunks_of_small(held.join(large, "_key", "left_anti"), grouped, name, fields, length)
    return small.unionByName(_chunks_of_large(held.join(large, "_key", "left_semi"), grouped, name, fields, length, tasks))


def _chunks_of_small(rows: DataFrame, grouped: list[str], name: str, fields: Sequence[str], length: int) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(*fields)))
    nested = rows.groupBy(*grouped).agg(items.alias("_items")).withColumn("n_items", F.size("_items").cast("long"))
    last = F.floor((F.col("n_items") - 1) / length).cast("int")
    cut = nested.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    part = F.slice("_items", F.col("chunk") * length + 1, F.lit(length))
    return cut.select(*grouped[1:], "chunk", "n_items", part.alias(name))


def _chunks_of_large(
    rows: DataFrame, grouped: list[str], name: str, fields: Sequence[str], length: int, tasks: int | None
) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in (*grouped, *fields)]
    placed = with_position(rows, order, tasks)
    sizes = placed.groupBy(*grouped).agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("n_items"))
    cut = null_safe_join(placed, sizes, grouped, "inner")
    cut = cut.withColumn("chunk", F.floor((F.col("position") - F.col("_first")) / length).cast("int"))
    items = F.array_sort(F.collect_list(F.struct("position", *fields)))
    nested = cut.groupBy(*grouped, "chunk", "n_items").agg(items.alias("_items"))
    bare = F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return nested.select(*grouped[1:], "chunk", "n_items", bare.alias(name))
