"""Hand-computed cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates, days, names, predicates, values
from rollbook.sources import calendar


def one(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, clean, bracket",
    [
        ("Kim Bo Yeon (Sharon) [김보연]", "Kim Bo Yeon (Sharon)", "김보연"),
        ("Kim Ji Hye [김지혜]  ", "Kim Ji Hye", "김지혜"),
        ("[a] middle [b]", "[a] middle", "a"),
        ("  plain\t", "plain", None),
        ("empty []", "empty []", None),
        (None, None, None),
    ],
)
def test_names(spark, name, clean, bracket):
    row = spark.createDataFrame([(name,)], "name string").select(
        names.clean_name().alias("c"), names.bracket_name().alias("b")
    ).first()
    assert (row["c"], row["b"]) == (clean, bracket)


def test_identity_key(spark):
    rows = spark.createDataFrame(
        [("p1", "A", None), (None, "Ann Lee", None), (None, "ANN lee", "안"), (None, None, "x")],
        "notion_page_id string, name string, korean_name string",
    )
    keys = [r[0] for r in rows.select(names.identity_key()).collect()]
    assert keys == ["p1", "ann lee::", "ann lee::안", None]


@pytest.mark.parametrize(
    "text, expected",
    [("MTWThF", [1, 2, 3, 4, 5]), ("SuSa", [0, 6]), ("XM", [1]), ("STh", [4]), ("", []), (None, []), ("MM", [1, 1])],
)
def test_days_parse(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(days.days_parse("t")).first()[0] == expected


def test_days_union(spark):
    df = spark.createDataFrame(
        [([("MW",), ("WF",)], None), ([], "ThTh"), ([(None,)], "M")], "s array<struct<days:string>>, t string"
    )
    got = [r[0] for r in df.select(days.days_union("s", "t")).collect()]
    assert got == [[1, 3, 5], [4, 4], []]


def test_mask_round_trip(spark):
    df = spark.range(128).select(F.col("id").cast("int").alias("m"))
    bad = df.filter(days.mask_text("m") != days.days_text(days.mask_days("m")))
    assert bad.count() == 0
    back = df.select(
        "m", F.aggregate(days.days_parse(days.mask_text("m")), F.lit(0), lambda a, d: a.bitwiseOR(days.mask_of(d))).alias("b")
    )
    assert back.filter("m <> b").count() == 0


@pytest.mark.parametrize(
    "minutes, text", [(0, "12:00 AM"), (539, "08:59 AM"), (720, "12:00 PM"), (780, "01:00 PM"), (1439, "11:59 PM")]
)
def test_time12(spark, minutes, text):
    assert one(spark, dates.time12(F.lit(minutes))) == text


@pytest.mark.parametrize(
    "text, number", [("12.5", 12.5), ("12abc", 12.0), (" -3e2x", -300.0), (".5", 0.5), ("abc", 0.0), (None, 0.0), ("", 0.0)]
)
def test_float_or_zero(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(values.float_or_zero("t")).first()[0] == number


@pytest.mark.parametrize(
    "amount, currency, text",
    [(1234.5, "PHP", "₱1,234.5"), (2000000.0, "KRW", "₩2,000,000"), (0.0, "PHP", "-"), (None, "KRW", "-"), (7.0, "USD", "₱7"), (1.23456, "PHP", "₱1.235")],
)
def test_money_text(spark, amount, currency, text):
    df = spark.createDataFrame([(amount, currency)], "amount double, currency string")
    assert df.select(values.money_text("amount")).first()[0] == text


def test_currency_and_labels(spark):
    df = spark.createDataFrame([("USD", "ta"), ("KRW", None), (None, "late")], "currency string, status string")
    got = df.select(values.currency_or_default(), values.status_code(), values.status_label()).collect()
    assert [tuple(r) for r in got] == [("PHP", "TA", "TA"), ("KRW", "", "Not marked"), ("PHP", "", "Not marked")]


@pytest.mark.parametrize("part, whole, pct", [(2, 3, 67), (1, 3, 33), (1, 8, 13), (0, 5, 0), (1, 0, None), (1, -1, None)])
def test_percentage(spark, part, whole, pct):
    assert one(spark, values.percentage(F.lit(part), F.lit(whole))) == pct


def test_status_list():
    assert values.parse_status_list(None) == ["present"]
    assert values.parse_status_list("") == ["present"]
    assert values.parse_status_list("present,, ,ta") == ["present", "ta"]
    assert values.parse_status_list("present, ta") == ["present", " ta"]


def test_hidden_as_of(spark):
    df = spark.createDataFrame([(2024, 2), (None, None), (2024, None)], "hidden_from_year int, hidden_from_month int")

    def shown(year, month):
        hit = F.coalesce(predicates.hidden_as_of(year, month), F.lit(False))
        return [r[0] for r in df.select(hit).collect()]

    assert shown(2024, 1) == [False, True, False]
    assert shown(2024, 2) == [True, True, False]
    assert shown(None, None) == [True, True, True]


def test_hidden_text_and_ranges(spark):
    assert one(spark, dates.hidden_from_text(F.lit(2024), F.lit(1))) == "January 2024"
    assert one(spark, dates.hidden_from_text(F.lit(2024), F.lit(None).cast("int"))) == "(All months)"
    late, early = F.lit(dt.date(2024, 3, 2)), F.lit(dt.date(2024, 2, 1))
    assert one(spark, dates.range_start(late, early)) == dt.date(2024, 2, 1)
    assert one(spark, dates.range_end(late, early)) == dt.date(2024, 3, 2)


def test_calendar(spark):
    rows = calendar.month_calendar(spark, 2024, 2).collect()
    assert len(rows) == 29 and rows[0]["weekday"] == 4 and rows[0]["weekday_name"] == "Thursday"
    assert sum(r["is_weekend"] for r in rows) == 8
    for year, month in [(2023, 2), (2024, 1), (2024, 2), (2024, 12)]:
        sets = dates.in_month_days(year, month)
        for r in calendar.month_calendar(spark, year, month).collect():
            assert sets[r["weekday"]] >> (r["day"] - 1) & 1


def test_external_label(spark):
    df = spark.createDataFrame([("7", 1), ("", 2), (None, 3)], "ext string, id int")
    got = [r[0] for r in df.select(names.external_label("ext", "id", "X-")).collect()]
    assert got == ["X-7", "ID: 2", "ID: 3"]


def test_day_flags(spark):
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1), "n")], "date date, name string")
    days_ = calendar.month_calendar(spark, 2024, 1)
    one_day = calendar.day_flags(days_, holidays, dt.date(2024, 1, 3), dt.date(2024, 1, 2), None)
    assert one_day.filter("in_range").count() == 1 and one_day.filter("is_holiday").count() == 1
    assert calendar.day_flags(days_, holidays, dt.date(2024, 1, 3), None, None).filter("in_range").count() == 0
