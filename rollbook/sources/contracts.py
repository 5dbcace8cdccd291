"""Data contracts: every check splits or reports, none drops silently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import keep_known
from rollbook.schema import CURRENCIES, FOREIGN_KEYS, STATUSES


def domain_rules() -> dict[str, Column]:
    """Per column the condition a known value meets."""
    return {
        "status": F.col("status").isin(*STATUSES),
        "currency": F.col("currency").isin(*CURRENCIES),
        "month": F.col("month").between(1, 12),
        "hidden_from_month": F.col("hidden_from_month").between(1, 12),
    }


def check_domain(df: DataFrame) -> DataFrame:
    """Adds ``violations``: the columns with a value outside their domain (NULL passes)."""
    found = [
        F.when(~rule, F.lit(name)) for name, rule in domain_rules().items() if name in df.columns
    ]
    return df.withColumn("violations", F.concat_ws(",", *found))


def check_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``missing``: required columns that are NULL, blank or zero."""
    kinds = dict(df.dtypes)

    def absent(name: str) -> Column:
        value = F.col(name)
        if kinds[name] == "string":
            return value.isNull() | (value == "")
        if kinds[name] in ("int", "bigint", "smallint", "double") or kinds[name].startswith("decimal"):
            return value.isNull() | (value == 0)
        return value.isNull()

    found = [F.when(absent(name), F.lit(name)) for name in columns]
    return df.withColumn("missing", F.concat_ws(",", *found))


def passed(checked: DataFrame, reason: str) -> DataFrame:
    return checked.filter(F.col(reason) == "").drop(reason)


def quarantined(checked: DataFrame, reason: str) -> DataFrame:
    return checked.filter(F.col(reason) != "")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a key with a NULL never collides."""
    counted = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter("n_rows > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows that point at no parent (a NULL reference is allowed)."""
    ids = parents.select(F.col(parent_key).alias("_parent"))
    referring = children.filter(F.col(child_key).isNotNull())
    return referring.join(ids, F.col(child_key) == F.col("_parent"), "left_anti")


def cascade_delete(children: dict[str, tuple[DataFrame, str]], parents: DataFrame) -> dict[str, DataFrame]:
    """Per child table the rows whose parent survives."""
    return {name: keep_known(df, parents, key, "id") for name, (df, key) in children.items()}


def cascade(
    tables: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame], graph: Mapping[str, Mapping[str, str]] = FOREIGN_KEYS
) -> dict[str, DataFrame]:
    """The rows of every table that survive the deletes of ``deleted`` (rows of some of the tables, by ``id``).

    The graph is walked parents first. A row goes if any of its parents goes, and then takes the rows that point at it
    along. A reference that is null or points at nothing keeps its row. Each table is read once: its parents' deleted ids
    are taken out one after the other.
    """
    left, gone = {}, dict(deleted)
    for name in TopologicalSorter({child: set(parents.values()) for child, parents in graph.items()}).static_order():
        if name not in tables:
            continue
        rows, whole = tables[name], tables[name]
        if name in deleted:
            rows = rows.join(deleted[name].select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")
        pointing = {column: parent for column, parent in graph.get(name, {}).items() if parent in gone}
        for column, parent in pointing.items():
            ids = gone[parent].select(F.col("id").alias("_gone"))
            rows = rows.join(ids, F.col(column) == F.col("_gone"), "left_anti")
        left[name] = rows
        if pointing and name in {p for parents in graph.values() for p in parents.values()}:
            gone[name] = whole.join(rows.select(F.col("id").alias("_kept")), F.col("id") == F.col("_kept"), "left_anti")
    return left


def orphan_counts(tables: Mapping[str, DataFrame], graph: Mapping[str, Mapping[str, str]] = FOREIGN_KEYS) -> DataFrame:
    """Per reference and value that finds no parent the number of rows: ``child``, ``reference``, ``value``, ``n_rows``.

    Rows are counted per value before parents are looked up.
    """
    found = []
    for child, references in graph.items():
        for column, parent in references.items():
            if child in tables and parent in tables:
                counted = tables[child].groupBy(F.col(column).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
                lost = orphans(counted, tables[parent], "value")
                found.append(lost.select(F.lit(child).alias("child"), F.lit(column).alias("reference"), "value", "n_rows"))
    return reduce(DataFrame.unionByName, found)
