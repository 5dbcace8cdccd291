"""The two functions that SQL text needs by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rollbook.schema import DAY_CODES

#: Bodies in SQL; they equal the column functions of the same name.
BODIES = {
    "identity_key(notion STRING, name STRING, korean STRING) RETURNS STRING":
        "coalesce(notion, concat(lower(name), '::', coalesce(korean, '')))",
    "days_parse(days STRING) RETURNS ARRAY<INT>":
        "coalesce(transform(regexp_extract_all(days, '(Su|Th|Sa|M|T|W|F)', 1), code -> CAST(array_position(array("
        + ", ".join(f"'{c}'" for c in DAY_CODES) + "), code) - 1 AS INT)), CAST(array() AS ARRAY<INT>))",
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of this session; Spark puts their bodies into the plan, so they cost what the body costs."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
