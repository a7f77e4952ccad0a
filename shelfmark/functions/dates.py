"""UTC days and months, and dates that carry a precision."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def utc_day(at: Column) -> Column:
    return at.cast("date")


def month_start(at: Column) -> Column:
    return F.trunc(at.cast("date"), "MM")


def month_key(at: Column) -> Column:
    return F.date_format(at.cast("date"), "yyyy-MM")


def days_before(now: datetime, days: int) -> Column:
    return instant(now) - F.make_dt_interval(F.lit(days))


def days_between(later: Column, earlier: Column) -> Column:
    """Days, with fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 86_400_000_000


def has_shipped(release: Column, precision: Column, now: datetime) -> Column:
    """A date of a day's precision is past once it is before now; one of a month's, once before this month."""
    cut = F.when(precision == "DAY", instant(now)).otherwise(F.date_trunc("MM", instant(now)).cast("timestamp_ntz"))
    return F.coalesce(release.cast("timestamp_ntz") < cut, F.lit(False))


def reissue_due(release: Column, precision: Column, preorder_closes: Column) -> Column:
    """The day after, the month after, or the end of preorders."""
    after = F.when(precision == "DAY", F.date_add(release.cast("date"), 1)).otherwise(F.add_months(F.trunc(release.cast("date"), "MM"), 1))
    return F.when(release.isNotNull(), after).otherwise(preorder_closes.cast("date"))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null for a day that does not exist."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def parsed_date(text: Column) -> Column:
    """The first of several written forms that fits, as struct(date, precision)."""

    def part(pattern: str, i: int) -> Column:
        got = F.regexp_extract(text, pattern, i)
        return F.when(got != "", got)

    slash = r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})"
    named = r"(\d{1,2})(?:st|nd|rd|th)?\.?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})"
    month_first = r"(?:[Ee]arly\s+|[Mm]id\s+|[Ll]ate\s+)?([A-Za-z]{3,9})\.?,?\s+(\d{4})"
    kanji = r"(\d{4})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?"
    year_month = r"(\d{4})[/.-](\d{1,2})(?![/.\d-])"
    middle = F.lit("15")
    found = lambda d, precision: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(precision).alias("precision")))
    return F.coalesce(
        found(safe_date(part(slash, 1), part(slash, 2), part(slash, 3)), "DAY"),
        found(safe_date(part(named, 3), month_number(part(named, 2)), part(named, 1)), "DAY"),
        found(safe_date(part(kanji, 1), part(kanji, 2), part(kanji, 3)), "DAY"),
        found(safe_date(part(kanji, 1), part(kanji, 2), middle), "MONTH"),
        found(safe_date(part(year_month, 1), part(year_month, 2), middle), "MONTH"),
        found(safe_date(part(month_first, 2), month_number(part(month_first, 1)), middle), "MONTH"),
    )
