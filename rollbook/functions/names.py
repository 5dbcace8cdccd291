"""Names, identities and display keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import col


def identity_key(notion_page_id="notion_page_id", name="name", korean_name="korean_name") -> Column:
    """One value per person: the page id, else lower-cased name and Korean name."""
    by_name = F.concat(F.lower(col(name)), F.lit("::"), F.coalesce(col(korean_name), F.lit("")))
    return F.coalesce(col(notion_page_id), by_name)


# The two bracket patterns and the parts of the identity key define the names.
def bracket_name(name="name") -> Column:
    """Text inside the first ``[...]``; NULL without one."""
    return F.nullif(F.regexp_extract(col(name), r"\[([^\]]+)\]", 1), F.lit(""))


def clean_name(name="name") -> Column:
    """The name without a trailing ``[...]`` and without outer white space."""
    bare = F.regexp_replace(col(name), r"(?U)\s*\[[^\]]+\]\s*$", "")
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def blank_to_null(value) -> Column:
    return F.nullif(col(value), F.lit(""))


def zero_to_null(value) -> Column:
    return F.when(col(value) != 0, col(value))


def row_key(student_id="id", subject="subject") -> Column:
    """Display key of a student-subject row; never used as a join key."""
    return F.concat_ws(
        "-", col(student_id).cast("string"), F.coalesce(blank_to_null(subject), F.lit("default"))
    )


def composite_id(first, second) -> Column:
    return F.concat_ws("-", col(first).cast("string"), col(second).cast("string"))


def external_label(external_id, student_id, prefix: str) -> Column:
    """``<prefix><external id>`` when there is one, else ``ID: <id>``."""
    return F.coalesce(
        F.concat(F.lit(prefix), blank_to_null(external_id)),
        F.concat(F.lit("ID: "), col(student_id).cast("string")),
    )
