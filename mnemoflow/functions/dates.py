"""Date mentions and timestamps as column expressions (UTC seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import MONTHS

DAY = 86400
_MONTHS = [m[:3].lower() for m in MONTHS]
_ORDINAL = "(?:st|nd|rd|th)?"


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(name, 1, 3))
    return F.when(at > 0, at.cast("int"))


def _day_range(y: Column, m: Column, d: Column, last: Column | None = None) -> Column:
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    start = F.unix_date(F.try_to_date(text, "yyyy-MM-dd")).cast("long") * DAY
    end = (F.unix_date(last).cast("long") if last is not None else F.unix_date(F.try_to_date(text, "yyyy-MM-dd")).cast("long")) * DAY + DAY - 1
    return F.when(start.isNotNull(), F.struct(start.alias("lo"), end.alias("hi")))


def date_range(c: Column) -> Column:
    """Inclusive range of Unix seconds of a lower-case date mention, at its precision: struct(lo, hi), or null.

    A mention without a year and a day that the calendar lacks give null.
    """

    def part(p: str, i: int) -> Column:
        return F.regexp_extract(c, p, i)

    def number(p: str, i: int) -> Column:
        return part(p, i).try_cast("int")

    iso, year = r"^(\d{4})-(\d{2})-(\d{2})$", r"^((?:19|20)\d{2})$"
    mdy, dmy = rf"^([a-z]+)\.?\s+(\d{{1,2}}){_ORDINAL}(?:,?\s+(\d{{4}}))?$", rf"^(\d{{1,2}}){_ORDINAL}\s+([a-z]+)\.?(?:\s+(\d{{4}}))?$"
    my = r"^([a-z]+)\.?\s+(\d{4})$"
    first = F.try_to_date(F.format_string("%04d-%02d-01", number(my, 2), _month(part(my, 1))), "yyyy-MM-dd")
    y = number(year, 1)
    return (
        F.when(c.rlike(iso), _day_range(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(c.rlike(mdy) & _month(part(mdy, 1)).isNotNull() & number(mdy, 2).between(1, 31), F.when(part(mdy, 3) != "", _day_range(number(mdy, 3), _month(part(mdy, 1)), number(mdy, 2))))
        .when(c.rlike(dmy) & _month(part(dmy, 2)).isNotNull(), F.when(part(dmy, 3) != "", _day_range(number(dmy, 3), _month(part(dmy, 2)), number(dmy, 1))))
        .when(c.rlike(my) & _month(part(my, 1)).isNotNull(), _day_range(number(my, 2), _month(part(my, 1)), F.lit(1), F.last_day(first)))
        .when(c.rlike(year), _day_range(y, F.lit(1), F.lit(1), F.try_to_date(F.format_string("%04d-12-31", y), "yyyy-MM-dd")))
    )


def iso_timestamp(c: Column) -> Column:
    """Unix seconds of YYYY-MM-DDTHH:MM[:SS[.frac]]Z; null for other zones, calendars or seconds beyond 59."""
    p = r"^(\d{4}-\d{1,2}-\d{1,2})T(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\.\d*)?Z$"
    day = F.try_to_date(F.regexp_extract(c, p, 1), "yyyy-M-d")
    h, m, s = (F.coalesce(F.regexp_extract(c, p, i).try_cast("int"), F.lit(0)) for i in (2, 3, 4))
    return F.when(c.rlike(p) & (h < 24) & (m < 60) & (s < 60), F.unix_date(day).cast("long") * DAY + h * 3600 + m * 60 + s)
