"""Dates as they stand on documents, as column expressions. Results are DD/MM/YYYY text; null if it is no calendar date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by their first three letters.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def dmy(text: Column) -> Column:
    """The date of D/M/YYYY text, or null."""
    return F.when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(text, "d/M/yyyy"))


def built(year: Column, month: Column, day: Column) -> Column:
    """DD/MM/YYYY of three numbers, given as columns of text or numbers."""
    text = F.concat_ws("/", day.cast("string"), month.cast("string"), F.lpad(year.cast("string"), 4, "0"))
    return F.date_format(F.try_to_date(text, "d/M/yyyy"), "dd/MM/yyyy")


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.upper(name), 1, 3)), F.lit(0))


def full_year(text: Column, as_of: Column) -> Column:
    """A year of four digits as it is; one of two in the last hundred years up to the given date; else null."""
    two = text.try_cast("int")
    century = F.when(two <= F.year(as_of) % 100, 2000).otherwise(1900)
    return F.when(F.length(text) == 4, two).when(F.length(text) == 2, century + two)


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in range(1, n + 1)]


def spelt(text: Column) -> Column:
    """First ``31 OCT 2025`` in a text, or else first ``OCT 31 2025``."""
    text = F.upper(F.trim(text))
    a, b = "([0-9]{1,2})\\s*([A-Z]{3})\\s*([0-9]{4})", "([A-Z]{3})\\s*([0-9]{1,2})\\s*([0-9]{4})"
    d1, m1, y1 = _groups(text, a, 3)
    m2, d2, y2 = _groups(text, b, 3)
    exact = lambda m: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), m), F.lit(0))
    return F.when(text.rlike(a), built(y1, exact(m1), d1)).when(text.rlike(b), built(y2, exact(m2), d2))


def any_format(text: Column, as_of: Column) -> Column:
    """ISO, then D/M/Y, then D Month Y; a pattern whose match is no date gives way to the next."""
    text = F.trim(text)
    y, m, d = _groups(text, "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 3)
    iso = built(y, m, d)
    d, m, y = _groups(text, "([0-9]{1,2})[/\\-.]([0-9]{1,2})[/\\-.]([0-9]{2,4})", 3)
    numeric = built(full_year(y, as_of), m, d)
    d, m, y = _groups(text, "([0-9]{1,2})\\s*([A-Za-z]{3,9})\\.?,?\\s*([0-9]{2,4})", 3)
    return F.coalesce(F.when(text.rlike("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), iso), numeric, built(full_year(y, as_of), month_number(m), d))


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "\\b((?:19|20)[0-9]{2})\\b", 1), F.lit(""))
