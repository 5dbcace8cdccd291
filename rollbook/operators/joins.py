"""Joins whose keys treat NULL as a value, and lookups with a default."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.spread import spread


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, tasks: int | None = None
) -> DataFrame:
    """Join on equally named keys, NULL matching NULL; the left key columns are kept.

    ``<=>`` is still an equi-join key, so the plan is a hash or sort-merge join. ``tasks`` deals
    both sides to that many tasks by all keys in one struct, which is equal where they are, NULL or not.
    """
    if tasks:
        key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        left = spread(left.withColumn("_keys", key), tasks, "_keys")
        other = spread(right.withColumn("_keys", key).drop(*keys), tasks, "_keys")
        return left.join(other, "_keys", how).drop("_keys")
    other = right
    for key in keys:
        other = other.withColumnRenamed(key, f"_right_{key}")
    matched = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    )
    joined = left.join(other, matched, how)
    return joined.drop(*[f"_right_{key}" for key in keys])


def keep_known(rows: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in ``known``."""
    ids = known.select(F.col(known_key or key).alias("_known"))
    return rows.join(ids, F.col(key) == F.col("_known"), "left_semi")


def drop_known(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys do not occur in ``known``, NULL matching NULL."""
    return null_safe_join(rows, known.select(*keys), keys, "left_anti")


def lookup(
    rows: DataFrame, table: DataFrame, key: str, table_key: str, defaults: dict[str, object]
) -> DataFrame:
    """Left join that fills columns missing in the lookup table with defaults."""
    side = table.select(F.col(table_key).alias("_lookup_key"), *defaults)
    joined = rows.join(side, F.col(key) == F.col("_lookup_key"), "left").drop("_lookup_key")
    for name, default in defaults.items():
        value = default if hasattr(default, "isNull") else F.lit(default)
        joined = joined.withColumn(name, F.coalesce(F.col(name), value))
    return joined
