"""CSV, JSON and keyed table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.compaction import latest_per_key
from rollbook.operators.ordering import positions, sorted_rows


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)


def grid_columns(grid: DataFrame, days: int) -> DataFrame:
    """Export layout of a month grid: four name columns (their headings are fixed values), then the days."""
    blank = [F.coalesce(c, F.lit("")) for c in ("korean_name", "subject", "teacher_name")]
    return grid.select(
        F.col("name").alias("Student Name"),
        blank[0].alias("Korean Name"),
        blank[1].alias("Subject"),
        blank[2].alias("Teacher"),
        *[F.col(f"d{day:02d}").alias(str(day)) for day in range(1, days + 1)],
    )


def csv_name(year: int, month: int) -> str:
    return f"attendance_{year}_{month:02d}.csv"


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes only around commas, quotes and line ends; quotes inside are doubled."""
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(
        path, schema=schema, header=True, quote='"', escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def with_month_partition(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("date"), "month": F.month("date")})


def write_month_partitions(df: DataFrame, path: str) -> None:
    """Replace exactly the months that occur in ``df``, one folder per month.

    Rows are gathered by month and then split or joined to files of even size, whatever the
    size of a month, and sorted so that a student's rows sit together in a file.
    """
    months = with_month_partition(df).hint("rebalance", F.col("year"), F.col("month"))
    (
        months.sortWithinPartitions("year", "month", "student_id", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(path)
    )


def write_split(checked: DataFrame, reason: str, path: str) -> None:
    """Write the rows of a check by verdict, ``passed`` or ``quarantined``, in one pass over the input."""
    verdict = F.when(F.coalesce(F.col(reason), F.lit("")) == "", "passed").otherwise("quarantined")
    checked.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").parquet(path)


def read_verdict(spark: SparkSession, path: str, schema, verdict: str) -> DataFrame:
    """One half of a split; the other half's files are not listed."""
    return spark.read.schema(schema.add("verdict", "string")).parquet(path).filter(F.col("verdict") == verdict)


def write_report(lines: DataFrame, order: Sequence, path: str) -> None:
    """JSON lines in one order over all files: each line tells its place by ``_at``."""
    sorted_rows(lines, order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """The lines of a report with their ``position``."""
    return positions(spark.read.schema(schema.add("_at", "long")).json(path))


def write_counted(rows: DataFrame, path: str, change: str = "change", number: str = "id") -> dict[str, dict[str, int]]:
    """Write a new state and count what changed in the same pass: per kind of ``change`` the rows, and the sum and the
    exclusive-or of their numbers. ``change`` is null where a row stays; it is not written."""
    seen = Observation()
    kinds = ("inserted", "updated", "deleted", "restored")
    metrics = []
    for kind in kinds:
        of = F.col(change) == kind
        metrics += [
            F.count_if(of).alias(f"{kind}_rows"), F.coalesce(F.sum(F.when(of, F.col(number))), F.lit(0)).alias(f"{kind}_sum"),
            F.coalesce(F.bit_xor(F.when(of, F.col(number))), F.lit(0)).alias(f"{kind}_xor"),
        ]
    rows.observe(seen, *metrics).drop(change).write.mode("overwrite").parquet(path)
    found = seen.get
    return {kind: {m: int(found[f"{kind}_{m}"]) for m in ("rows", "sum", "xor")} for kind in kinds}


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(target) if s.isDirectory())


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _filesystem(spark, source)
    to = _filesystem(spark, target)[1]
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"could not move {source} to {target}")


def _touch(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.create(target, True).close()


def swap_months(spark: SparkSession, staged: str, path: str) -> None:
    """Move the month folders of ``staged`` into the table: nothing is written again.

    For each month the stored folder steps aside, then the new one takes its place. A folder that is still staged has not
    been moved, so a swap that broke off anywhere is finished by doing it again; ``_SWAPPED`` says that it is done, and
    only then the old folders go. Between the two moves of a month a reader misses that month.
    """
    if path_exists(spark, f"{staged}/_SWAPPED"):
        return
    for year in _children(spark, staged):
        if "/year=" not in year:
            continue
        for month in _children(spark, year):
            name = "/".join(month.rstrip("/").split("/")[-2:])
            target, aside = f"{path}/{name}", f"{staged}/_before/{name}"
            if path_exists(spark, aside):
                remove_path(spark, target)  # a move that a store without renames left half done
            elif path_exists(spark, target):
                _rename(spark, target, aside)
            _rename(spark, month, target)
    _touch(spark, f"{staged}/_SWAPPED")
    remove_path(spark, f"{staged}/_before")


def upsert_months(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    batch: str,
) -> None:
    """Merge changes into a month-partitioned table, touching only the months they name.

    The merged months are written once, beside the table, and then moved in. A batch that
    is run again finds its finished copy and only goes on with the moves, so a lost driver
    leaves neither a half-written month nor a change applied twice. ``batch`` names the
    batch and must not be used again for other changes.
    """
    staged = f"{path}.staging/{batch}"
    if not path_exists(spark, f"{staged}/_STAGED"):  # overwriting by partition leaves no mark of its own
        remove_path(spark, staged)
        merged = changes
        if path_exists(spark, path):
            ordinal = F.col("year") * 12 + F.col("month")
            # only the numbers of the months of this batch reach the driver; with them as
            # literals the other months' folders are not even listed
            months = with_month_partition(changes.select("date")).agg(F.collect_set(ordinal))
            stored = spark.read.parquet(path).filter(ordinal.isin(months.first()[0]))
            merged = stored.select(*changes.columns).unionByName(changes)
        write_month_partitions(latest_per_key(merged, keys, order), staged)
        _touch(spark, f"{staged}/_STAGED")
    swap_months(spark, staged, path)
