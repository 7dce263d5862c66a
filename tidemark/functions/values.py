"""Numbers, times and fall-backs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import _col

#: Exact type of money columns in state tables.
MONEY = "decimal(18,4)"
#: Epoch values below this are seconds, others milliseconds.
EPOCH_MS_FLOOR = 100_000_000_000


def money(c: Column | str) -> Column:
    """Exact decimal of a number, bad text becomes null."""
    return _col(c).try_cast(MONEY)


def decimal_text(c: Column | str) -> Column:
    """Plain decimal text without trailing zeros (never exponent notation)."""
    return F.regexp_replace(money(c).cast("string"), r"\.?0+$", "")


def number_or_none(c: Column | str) -> Column:
    """Non-negative number in free text such as ``$120,000``; else null."""
    kept = F.regexp_replace(_col(c).cast("string"), r"[^0-9.+-]", "")
    number = kept.try_cast("double")
    return F.when(number >= 0, number)


def to_int(c: Column | str) -> Column:
    """Integer value, 0 when missing or not a number."""
    return F.coalesce(_col(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_declared(columns: list[str], *names: str, default=None) -> Column:
    """The first of ``names`` the table declares, else a constant."""
    for name in names:
        if name in columns:
            return F.col(name)
    return F.lit(default)


def first_filled(*columns: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in columns])


def epoch_ms(c: Column | str) -> Column:
    """Epoch milliseconds of a value that may be seconds or milliseconds."""
    n = _col(c).try_cast("bigint")
    return F.when(n < EPOCH_MS_FLOOR, n * 1000).otherwise(n)


def shown_time(c: Column | str) -> Column:
    """ISO text of an epoch value, a dash for null or 0."""
    ms = epoch_ms(c)
    text = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
    return F.when(ms.isNull() | (ms == 0), F.lit("—")).otherwise(text)


def hit_rate(hits: Column | str, misses: Column | str) -> Column:
    """Hits per hundred lookups, 0 without lookups, one decimal."""
    hits, misses = _col(hits), _col(misses)
    share = 100.0 * hits / F.nullif(hits + misses, F.lit(0).cast("bigint"))
    return F.round(F.coalesce(share, F.lit(0.0)), 1)
