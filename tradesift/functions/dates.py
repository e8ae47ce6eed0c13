"""Trade dates in several formats, spans of weeks, time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradesift.config import TRADE_DATE_FORMATS


def parse_trade_date(raw: Column) -> Column:
    """The first format that fits, or null. Single-letter fields accept one or two digits; the year needs four."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(f)).cast("date") for f in TRADE_DATE_FORMATS])


def span_weeks(dates: Column) -> Column:
    """Text: whole weeks between the first and last known date of an array, at least 1; "several" below two dates."""
    known = F.filter(dates, lambda d: d.isNotNull())
    weeks = F.bround(F.datediff(F.array_max(known), F.array_min(known)) / 7, 0).cast("int")
    return F.when(F.size(known) < 2, F.lit("several")).otherwise(F.greatest(F.lit(1), weeks).cast("string"))


def since(ts: Column, as_of: Column, **span: int) -> Column:
    """``ts`` is at or after ``as_of`` less a span; there is no upper bound."""
    return ts >= as_of - F.make_dt_interval(F.lit(span.get("days", 0)), F.lit(span.get("hours", 0)), F.lit(span.get("minutes", 0)))
