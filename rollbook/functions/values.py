"""Statuses, numbers and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import col
from rollbook.schema import CURRENCIES, DEFAULT_CURRENCY

# Display forms.
STATUS_CODES = {"present": "P", "absent": "A", "ta": "TA", "noshow": "N"}
STATUS_LABELS = {"present": "Present", "absent": "Absent", "ta": "TA", "noshow": "No Show"}
CURRENCY_SYMBOLS = {"PHP": "₱", "KRW": "₩"}

_LEADING_FLOAT = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_LEADING_INT = r"^\s*([+-]?\d+)"


def _lookup(value, table: dict[str, str], default: str) -> Column:
    result = F.lit(default)
    for key, shown in table.items():
        result = F.when(col(value) == key, F.lit(shown)).otherwise(result)
    return result


def status_code(status="status") -> Column:
    return _lookup(status, STATUS_CODES, "")


def status_label(status="status") -> Column:
    return _lookup(status, STATUS_LABELS, "Not marked")


def float_or_zero(text) -> Column:
    """Leading number of a text; 0 when there is none."""
    return F.coalesce(F.regexp_extract(col(text), _LEADING_FLOAT, 1).try_cast("double"), F.lit(0.0))


def int_or_zero(text) -> Column:
    return F.coalesce(F.regexp_extract(col(text), _LEADING_INT, 1).try_cast("bigint"), F.lit(0))


def currency_or_default(currency="currency") -> Column:
    return F.when(col(currency).isin(*CURRENCIES), col(currency)).otherwise(F.lit(DEFAULT_CURRENCY))


def money_text(amount, currency="currency") -> Column:
    """Symbol and grouped digits; ``-`` for zero and NULL."""
    symbol = _lookup(currency, CURRENCY_SYMBOLS, CURRENCY_SYMBOLS[DEFAULT_CURRENCY])
    digits = F.call_function("format_number", F.round(col(amount), 3), F.lit("#,##0.###"))
    return F.when(col(amount) != 0, F.concat(symbol, digits)).otherwise(F.lit("-"))


def round_half_up(value) -> Column:
    return F.floor(col(value) + F.lit(0.5))


def percentage(part, whole) -> Column:
    """Whole percent, rounded half up; NULL unless the whole is positive."""
    return F.when(col(whole) > 0, round_half_up(col(part) / col(whole) * 100))


def pct_band(pct, high: int, low: int) -> Column:
    return (
        F.when(col(pct).isNull(), F.lit("none"))
        .when(col(pct) >= high, F.lit("high"))
        .when(col(pct) >= low, F.lit("middle"))
        .otherwise(F.lit("low"))
    )


def amount(rate, count) -> Column:
    """Exact decimal product of a rate and a class count."""
    return col(rate).cast("decimal(10,2)") * col(count).cast("decimal(19,0)")


def parse_status_list(text: str | None) -> list[str]:
    """Comma list to statuses: blanks dropped, ``['present']`` when nothing was given."""
    return [part for part in text.split(",") if part.strip()] if text else ["present"]
