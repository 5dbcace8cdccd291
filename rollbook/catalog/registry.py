"""Registration of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.catalog import views
from rollbook.operators import identity
from rollbook.operators.compaction import latest_per_key
from rollbook.operators.spread import spread, tasks_for
from rollbook.plans import records
from rollbook.plans.roster import build_roster, schedule_slots
from rollbook.schema import KEYS
from rollbook.sources.readers import read_table

YEAR, MONTH = 2024, 1
#: Derived tables whose statement removes repeated rows: the given table it reads, and a column to deal that by.
DEALT = {"assignment_teachers": ("lineitem", "l_orderkey")}


class Tables:
    """The given tables and those derived from them, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    @cached_property
    def attendance(self) -> DataFrame:
        """Current state of the log: the last write per student, date and subject."""
        latest = latest_per_key(self.attendance_log, KEYS["attendance"], ["updated_at", "id"])
        return latest.withColumnRenamed("is_delete", "is_deleted").withColumn(
            "deleted_at", F.when(F.col("is_deleted"), F.col("updated_at"))
        )

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in views.BASE:
                frame = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
            elif name in views.TABLES:
                frame = self.sql(views.TABLES[name], *DEALT.get(name, ()))
            else:
                raise AttributeError(name)
            self._frames[name] = frame
        return self._frames[name]

    def sql(self, text: str, dealt: str = "", by: str = "") -> DataFrame:
        """Run SQL whose table names are the given or derived tables, one of them ``dealt`` by a column if it is large."""
        known = [*views.BASE, *views.TABLES]
        used = views._needs(text, dict.fromkeys(known, ""))
        for name in used:
            text = views.re.sub(rf"(?i)\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
        frames = {n: getattr(self, n) for n in used if f"{{{n}}}" in text}
        if dealt:
            frames[dealt] = spread(frames[dealt], self.tasks, by)
        return self.spark.sql(text, **frames)

    @cached_property
    def tasks(self) -> int | None:
        """Tasks for the steps over all assignments; the rows are counted in the file footers."""
        return tasks_for(self.spark, self.lineitem.count())

    @cached_property
    def remap(self) -> DataFrame:
        return identity.id_remap(self.students, self.assignments, self.assignment_students, self.tasks)

    @cached_property
    def persons(self) -> DataFrame:
        return identity.person_ids(self.students)

    @cached_property
    def slots(self) -> DataFrame:
        return schedule_slots(
            self.students, self.teachers, self.time_slots, self.assignments,
            self.assignment_students, self.assignment_teachers, tasks=self.tasks,
        )

    def _roster(self, *month: int) -> DataFrame:
        return build_roster(
            self.slots, self.students, self.teachers, self.student_subject_tuition, self.hidden_attendance_rows, *month,
            tasks=self.tasks,
        )

    @cached_property
    def roster(self) -> DataFrame:
        return self._roster(YEAR, MONTH)

    @cached_property
    def roster_all(self) -> DataFrame:
        return self._roster()

    @cached_property
    def records(self) -> DataFrame:
        return records.month_records(self.attendance, self.remap, YEAR, MONTH)

    @cached_property
    def cells(self) -> DataFrame:
        return records.cells(self.records)

    @cached_property
    def marked(self) -> DataFrame:
        return records.roster_month(self.roster, self.cells, self.tasks)


Builder = Callable[[Tables], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query and, if there is one, its equivalent SQL."""

    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Output types both engines write alike: decimals as doubles, timestamps as text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        out.append(column.alias(field.name))
    return df.select(*out)


_TABLES: dict[tuple[str, int, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder, analysed once per session."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(QUERIES[name](tables(spark, sf_dir)))
