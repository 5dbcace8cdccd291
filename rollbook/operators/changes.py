"""Batches of changes applied to a table: (state, changes) -> new state.

A batch may hold any number of changes, many to one key. Changes to one key are reduced
by an aggregate before they meet the state.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.names import blank_to_null
from rollbook.functions.values import currency_or_default
from rollbook.operators.identity import apply_remap
from rollbook.operators.joins import drop_known, null_safe_join
from rollbook.schema import DEFAULT_CURRENCY, KEYS, STATUSES

CELL = ["student_id", "date", "subject"]


def upsert(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    updates: Sequence[str],
    order: Sequence[str] = ("changed_at", "seq"),
) -> DataFrame:
    """Insert or update on a key; the last change per key wins, other columns stay.

    State and changes meet in one aggregate on the key, NULL keys included, so there is
    one shuffle and no join.
    """
    kept = [c for c in state.columns if c not in keys and c not in updates]
    old = state.select(*keys, F.struct(*updates, *kept).alias("_old"))
    new = changes.select(*keys, F.struct(*order, *updates).alias("_new"))
    merged = (
        new.unionByName(old, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"))
    )
    changed = F.col("_new").isNotNull()
    return merged.select(
        *[
            F.col(c)
            if c in keys
            else F.when(changed, F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c)
            if c in updates
            else F.col("_old")[c].alias(c)
            for c in state.columns
        ]
    )


def _lone(subject_mode: str, unique) -> list:
    """Extra key that keeps rows without a subject apart in ``distinct`` mode."""
    if subject_mode == "one":
        return []
    return [F.when(F.col("subject").isNull(), unique).alias("_lone")]


def set_records(
    state: DataFrame,
    changes: DataFrame,
    keep_notes: bool = False,
    null_subject_mode: str = "one",
    mark: str | None = None,
) -> DataFrame:
    """Set presence: insert, update or revive; the latest of state and changes wins.

    ``changes``: student_id, date, subject, status, notes, changed_at, seq. A single set
    overwrites notes, a bulk set (``keep_notes``) leaves those of the stored record. By
    default rows without a subject are one row per student and day; in ``distinct`` mode
    each write without a subject adds a row.
    """
    payload = ["status", "notes", "is_deleted", "deleted_at"]
    old = state.select(
        *CELL,
        *_lone(null_subject_mode, F.concat(F.lit("s"), F.col("id").cast("string"))),
        F.struct(
            F.col("updated_at").alias("at"), F.lit(None).cast("long").alias("seq"),
            *[F.col(c) for c in payload],
        ).alias("_row"),
        F.struct("updated_at", "id", "notes").alias("_stored"),
    )
    kinds = {f.name: f.dataType for f in state.schema.fields}
    new = changes.withColumn("subject", blank_to_null("subject")).select(
        *CELL,
        *_lone(null_subject_mode, F.concat(F.lit("c"), F.col("seq").cast("string"))),
        F.struct(
            F.col("changed_at").alias("at"), F.col("seq").cast("long").alias("seq"), "status",
            (F.lit(None) if keep_notes else F.col("notes")).cast(kinds["notes"]).alias("notes"),
            F.lit(False).alias("is_deleted"),
            F.lit(None).cast(kinds["deleted_at"]).alias("deleted_at"),
        ).alias("_row"),
    )
    keys = [*CELL] + ([] if null_subject_mode == "one" else ["_lone"])
    merged = (
        old.unionByName(new, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max("_row").alias("_row"), F.max("_stored").alias("_stored"))
    )
    notes = F.col("_stored.notes") if keep_notes else F.col("_row.notes")
    values = {
        "id": F.coalesce(F.col("_stored.id").cast("long"), _new_id(state, F.col("_row.seq"))),
        "status": F.col("_row.status"),
        "notes": notes,
        "is_deleted": F.coalesce("_row.is_deleted", F.lit(False)),
        "deleted_at": F.col("_row.deleted_at"),
        "updated_at": F.col("_row.at"),
    }
    written = F.when(F.col("_row.seq").isNotNull(), F.when(F.col("_stored").isNull(), "inserted").otherwise("updated"))
    marks = [] if mark is None else [written.alias(mark)]
    return merged.select(*[F.col(c) if c in CELL else values[c].alias(c) for c in state.columns], *marks)


def _new_id(state: DataFrame, seq: Column) -> Column:
    """An id no stored row has: the change number above the highest stored id."""
    return F.coalesce(state.agg(F.max("id").cast("long")).scalar(), F.lit(0)) + seq.cast("long")


def bulk_set_records(state: DataFrame, changes: DataFrame, mark: str | None = None) -> DataFrame:
    """``mark`` names a column that tells rows ``inserted`` or ``updated`` from those that stay (null)."""
    return set_records(state, changes, keep_notes=True, mark=mark)


def _with_owner(rows: DataFrame, persons: DataFrame | None) -> DataFrame:
    """Adds ``owner``: the person behind the student id, or the id itself."""
    if persons is None:
        return rows.withColumn("owner", F.col("student_id"))
    side = persons.select(F.col("id").alias("_pid"), "person_id")
    joined = rows.join(side, F.col("student_id") == F.col("_pid"), "left")
    return joined.withColumn("owner", F.coalesce("person_id", "student_id")).drop("_pid", "person_id")


def _flag_deleted(
    state: DataFrame, changes: DataFrame, persons: DataFrame | None, delete: bool, mark: str | None = None
) -> DataFrame:
    asked = (
        _with_owner(changes.withColumn("subject", blank_to_null("subject")), persons)
        .groupBy("owner", "date", "subject")
        .agg(F.min("changed_at").alias("_at"))
    )
    joined = null_safe_join(_with_owner(state, persons), asked, ["owner", "date", "subject"], "left")
    gone = F.coalesce("is_deleted", F.lit(False))
    hit = F.col("_at").isNotNull() & (~gone if delete else gone)
    marked = joined.withColumn("_hit", hit)
    values = {
        "is_deleted": F.when(F.col("_hit"), F.lit(delete)).otherwise(gone),
        "deleted_at": F.when(F.col("_hit"), F.col("_at") if delete else F.lit(None)).otherwise(
            F.col("deleted_at")
        ),
    }
    marks = [] if mark is None else [F.when(F.col("_hit"), F.lit("deleted" if delete else "restored")).alias(mark)]
    return marked.select(*[values[c].alias(c) if c in values else F.col(c) for c in state.columns], *marks)


def soft_delete(
    state: DataFrame, changes: DataFrame, persons: DataFrame | None = None, mark: str | None = None
) -> DataFrame:
    """Mark live records deleted; with ``persons`` under every id of the person."""
    return _flag_deleted(state, changes, persons, True, mark)


def undo_delete(
    state: DataFrame, changes: DataFrame, persons: DataFrame | None = None, mark: str | None = None
) -> DataFrame:
    """Restore deleted records; with ``persons`` under every id of the person."""
    return _flag_deleted(state, changes, persons, False, mark)


def _entries_on(entries: DataFrame, date: dt.date, at) -> DataFrame:
    return entries.select("student_id", "subject", F.lit(date).alias("date"), at.alias("changed_at"))


def bulk_delete(state: DataFrame, entries: DataFrame, date: dt.date, at, mark: str | None = None) -> DataFrame:
    """Delete the entries of one date, under exactly the ids given."""
    return soft_delete(state, _entries_on(entries, date, at), mark=mark)


def bulk_undo(state: DataFrame, entries: DataFrame, date: dt.date, at, mark: str | None = None) -> DataFrame:
    return undo_delete(state, _entries_on(entries, date, at), mark=mark)


def toggle_records(state: DataFrame, toggles: DataFrame, persons: DataFrame) -> DataFrame:
    """Each toggle moves a cell on: none, present, absent, ta, noshow, none.

    ``toggles``: student_id, date, subject, changed_at, seq. A cell belongs to a person;
    its record (highest student id, then id, if there are several) moves to the id of the
    last toggle. Passing through "none" deletes the person's other live records of the
    cell. n toggles are one step: the starting position plus n, modulo 5.
    """
    cell = ["owner", "date", "subject"]
    asked = (
        _with_owner(toggles.withColumn("subject", blank_to_null("subject")), persons)
        .groupBy(*cell)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(F.struct("changed_at", "seq", "student_id")).alias("_last"),
        )
    )
    owned = _with_owner(state, persons)
    live = owned.filter(~F.coalesce("is_deleted", F.lit(False)))
    current = live.groupBy(*cell).agg(
        F.max(F.struct("student_id", "id", "status", "notes")).alias("_cur")
    )
    position = F.when(F.col("_cur").isNull(), F.lit(0))
    for i, status in enumerate(STATUSES[:-1]):
        position = position.when(F.col("_cur.status") == status, F.lit(i + 1))
    position = position.otherwise(F.lit(len(STATUSES)))
    steps = null_safe_join(asked, current, cell, "left").withColumn("_total", position + F.col("_n"))
    at_end = (F.col("_total") % (len(STATUSES) + 1)).cast("int")
    names = F.array(F.lit(STATUSES[-1]), *[F.lit(s) for s in STATUSES])
    kinds = {f.name: f.dataType for f in state.schema.fields}
    untouched = (F.col("_n") == 1) & (at_end == 0)
    moved = {
        "id": F.coalesce(F.col("_cur.id").cast("long"), _new_id(state, F.col("_last.seq"))),
        "student_id": F.col("_last.student_id"),
        "status": F.get(names, at_end),
        "notes": F.when(untouched, F.col("_cur.notes")),
        "is_deleted": at_end == 0,
        "deleted_at": F.when(at_end == 0, F.col("_last.changed_at")),
        "updated_at": F.col("_last.changed_at"),
    }
    toggled = steps.select(
        *[(moved[c] if c == "id" else moved[c].cast(kinds[c])).alias(c) if c in moved else F.col(c) for c in state.columns]
    )
    decided = steps.select(
        *cell, F.col("_cur.id").alias("_cur_id"), F.col("_last.student_id").alias("_home"),
        (F.col("_total") > len(STATUSES)).alias("_cleared"), F.col("_last.changed_at").alias("_when"),
    )
    others = null_safe_join(owned, decided, cell, "left")
    replaced = F.col("_home").isNotNull() & (
        (F.col("student_id") == F.col("_home")) | F.col("id").eqNullSafe(F.col("_cur_id"))
    )
    gone = F.coalesce("is_deleted", F.lit(False))
    swept = F.coalesce("_cleared", F.lit(False)) & ~gone
    rest = others.filter(~F.coalesce(replaced, F.lit(False))).withColumn("_swept", swept)
    kept = {
        "is_deleted": F.col("_swept") | gone,
        "deleted_at": F.when(F.col("_swept"), F.col("_when")).otherwise(F.col("deleted_at")),
    }
    unchanged = rest.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in state.columns])
    return unchanged.unionByName(toggled)


def rehome(state: DataFrame, remap: DataFrame) -> DataFrame:
    """Move records to canonical ids; of several on one cell the live one stays, then the
    one with the highest original id, then the highest id."""
    moved = apply_remap(state, remap)
    rest = [c for c in state.columns if c not in CELL and c != "id"]
    live = (~F.coalesce("is_deleted", F.lit(False))).alias("_live")
    picked = moved.groupBy(*CELL).agg(F.max(F.struct(live, "original_id", "id", *rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in CELL else F.col("_row")[c].alias(c) for c in state.columns])


def set_notes(state: DataFrame, changes: DataFrame) -> DataFrame:
    clean = changes.withColumns(
        {"subject": blank_to_null("subject"), "notes": F.coalesce("notes", F.lit(""))}
    )
    return upsert(state, clean, KEYS["student_notes"], ["notes"])


def set_holidays(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Holidays by date; a new one takes an id above all stored ones."""
    named = changes.withColumn("name", F.coalesce("name", F.lit("")))
    merged = upsert(state.withColumn("_seq", F.lit(None).cast("long")), named.withColumn("_seq", F.col("seq")),
                    KEYS["holidays"], ["name", "_seq"])
    return merged.withColumn("id", F.coalesce(F.col("id").cast("long"), _new_id(state, F.col("_seq")))).drop("_seq")


def delete_holidays(state: DataFrame, ids: DataFrame) -> DataFrame:
    return state.join(ids.select("id"), "id", "left_anti").select(*state.columns)


def set_rates(state: DataFrame, changes: DataFrame, keys: Sequence[str], rate: str) -> DataFrame:
    """Upsert of commission or tuition rates; an unknown currency becomes PHP."""
    clean = changes.withColumns(
        {"currency": currency_or_default("currency"), rate: F.col(rate).cast("decimal(10,2)")}
    )
    return upsert(state, clean, keys, [rate, "currency"])


def set_payments(state: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return upsert(state, changes, keys, ["paid", "payment_date", "notes"])


def toggle_payments(state: DataFrame, toggles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flip ``paid`` once per toggle; the payment date is the day of the last toggle, or none.

    Everything else of a stored row, its notes too, is kept.
    """
    kept = [c for c in state.columns if c not in keys]
    old = state.select(*keys, F.struct(*kept).alias("_old"))
    new = toggles.select(*keys, F.to_date("changed_at").alias("_day"))
    merged = (
        old.unionByName(new, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max("_old").alias("_old"), F.count("_day").alias("_n"), F.max("_day").alias("_day"))
    )
    was_paid = F.coalesce("_old.paid", F.lit(False))
    paid = was_paid != (F.col("_n") % 2 == 1)
    values = {
        "paid": paid,
        "payment_date": F.when(F.col("_n") == 0, F.col("_old.payment_date")).when(paid, F.col("_day")),
    }
    return merged.select(
        *[
            F.col(c) if c in keys else values.get(c, F.col("_old")[c] if c in kept else None).alias(c)
            for c in state.columns
        ]
    )


def add_subjects(state: DataFrame, adds: DataFrame) -> DataFrame:
    """Insert a zero price for pairs that have none; nothing else changes."""
    keys = list(KEYS["student_subject_tuition"])
    fresh = drop_known(adds.select(*keys).distinct(), state, keys)
    kinds = state.schema
    return state.unionByName(
        fresh.withColumns(
            {
                "price_per_class": F.lit(0).cast(kinds["price_per_class"].dataType),
                "currency": F.lit(DEFAULT_CURRENCY),
            }
        ),
        allowMissingColumns=True,
    )


def delete_subjects(
    rates: DataFrame, payments: DataFrame, deletes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove the price of a pair and all its payments."""
    keys = ["student_id", "subject"]
    gone = deletes.select(*keys).distinct()
    return (
        rates.join(gone, keys, "left_anti").select(*rates.columns),
        payments.join(gone, keys, "left_anti").select(*payments.columns),
    )


def skip_unchanged(
    changes: DataFrame, state: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Changes that differ from the stored values, or have nothing stored."""
    stored = state.select(*keys, F.struct(*columns).alias("_stored"))
    joined = null_safe_join(changes, stored, list(keys), "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col("_stored")[c])
    return joined.filter(F.col("_stored").isNull() | differs).drop("_stored")


def affected(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a batch inserted, updated or removed, with their new values."""
    values = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*values).alias("_old"))
    after = new.select(*keys, F.struct(*values).alias("_new"))
    both = (
        before.unionByName(after, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
        .filter(~F.col("_old").eqNullSafe(F.col("_new")))
    )
    kind = (
        F.when(F.col("_old").isNull(), F.lit("inserted"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .otherwise(F.lit("updated"))
    )
    return both.select(
        *keys, kind.alias("change"), *[F.col("_new")[c].alias(c) for c in values]
    )


def hide_rows(state: DataFrame, changes: DataFrame, today: dt.date) -> DataFrame:
    """Hide student-subject rows from a month on, the current one by default."""
    filled = changes.withColumns(
        {
            "subject": blank_to_null("subject"),
            "hidden_from_year": F.coalesce(F.nullif(F.col("hidden_from_year"), F.lit(0)), F.lit(today.year)),
            "hidden_from_month": F.coalesce(
                F.nullif(F.col("hidden_from_month"), F.lit(0)), F.lit(today.month)
            ),
            "hidden_at": F.col("changed_at"),
        }
    )
    return upsert(
        state, filled, KEYS["hidden_attendance_rows"],
        ["hidden_from_year", "hidden_from_month", "hidden_at"],
    )


def unhide_rows(state: DataFrame, entries: DataFrame) -> DataFrame:
    clean = entries.withColumn("subject", blank_to_null("subject"))
    return drop_known(state, clean, ["student_id", "subject"])
