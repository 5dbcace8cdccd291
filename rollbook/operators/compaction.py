"""One row per key out of many versions, as a plain aggregate.

``max(struct(...))`` combines on the map side, so a key that holds a large share of
the rows reaches its reducer as one row per map task. A window over the same key
would send every version to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last(name: str) -> list[Column]:
    """Two struct fields that sort like ``name ASC NULLS LAST``."""
    return [F.col(name).isNull().alias(f"_{name}_null"), F.col(name)]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; NULL keys group together."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that comes first in ``order`` per key; the whole row breaks ties."""
    ranked = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*ranked, *rest)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
