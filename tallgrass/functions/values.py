"""Quantities, dates and the several meanings of "no value"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The project's notations.
NO_DATE = ["00/00/0000"]
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def quantity(text: Column) -> Column:
    """The number of a text in the notation ``1.000,000``; null if it is none (also for "nan")."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain.rlike(PLAIN_NUMBER), plain.try_cast("double"))


def quantity_text(number: Column, decimals: int = 3) -> Column:
    """The inverse of :func:`quantity`."""
    return F.translate(F.format_number(number, decimals), ",.", ".,")


def day(text: Column, no_date: Sequence[str] = NO_DATE) -> Column:
    """The date of a text MM/DD/YYYY (leading zeros may lack); null for none, an impossible day or a stand-in."""
    t = F.trim(text)
    shaped = t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") & ~t.isin(*no_date)
    return F.when(shaped, F.try_to_timestamp(t, F.lit("M/d/yyyy")).cast("date"))


def day_text(date: Column) -> Column:
    return F.date_format(date, "MM/dd/yyyy")


def missing_strict(value: Column) -> Column:
    """Null and nothing else: the rule executor's and profiler's meaning; '' is populated."""
    return value.isNull()


def missing_or_blank(value: Column, no_date: Sequence[str] = NO_DATE) -> Column:
    """Null, blank after trimming, or a date's stand-in."""
    return value.isNull() | (F.trim(value) == "") | F.trim(value).isin(*no_date)


def missing_text(value: Column) -> Column:
    """The text normaliser's meaning: null, blank, or the words nan and none."""
    return value.isNull() | F.lower(F.trim(value)).isin("", "nan", "none")


def missing_entry(value: Column) -> Column:
    """The matcher's meaning: null, blank, or the word nan."""
    return value.isNull() | F.trim(value).isin("", "nan")


# The notations of dates (shape, parse pattern); slashes put the month first, dots the day.
DATE_NOTATIONS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]


def calendar_day(text: Column, not_after: Column) -> Column:
    """The day a text names in any unambiguous notation; null if it is no real day or lies after ``not_after``."""
    trimmed = F.trim(text)
    day = None
    for shape, pattern in DATE_NOTATIONS:
        parsed = F.try_to_timestamp(trimmed, F.lit(pattern)).cast("date")
        day = F.when(trimmed.rlike(shape), parsed) if day is None else day.when(trimmed.rlike(shape), parsed)
    return F.when(day <= not_after.cast("date"), day)
