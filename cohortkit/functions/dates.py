"""Date, month and week expressions.

Months are carried as ``'yyyy-MM'`` strings (the reference's grain) and, for
arithmetic, as a month index ``year * 12 + month - 1`` so that month
distances are exact integers and window frames do not depend on day counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_str(date_col) -> Column:
    """date/timestamp -> 'yyyy-MM'."""
    return F.date_format(_c(date_col), "yyyy-MM")


def month_index(date_col) -> Column:
    """date/timestamp -> year*12 + month - 1."""
    d = _c(date_col)
    return F.year(d) * 12 + F.month(d) - 1


def month_index_of_str(month_col) -> Column:
    """'yyyy-MM' string -> month index."""
    m = _c(month_col)
    return (F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int") - 1)


def month_from_index(idx_col) -> Column:
    """month index -> 'yyyy-MM'."""
    i = _c(idx_col)
    return F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"))



def week_start(date_col) -> Column:
    """Monday of the week (date_trunc('week') is Monday-based)."""
    return F.to_date(F.date_trunc("week", _c(date_col)))


def parse_date(str_col, fmt: str) -> Column:
    """Lenient string -> date: bad text gives null instead of failing (ANSI safe)."""
    return F.try_to_timestamp(_c(str_col), F.lit(fmt)).cast("date")


def parse_date_any(str_col, fmts=("yyyyMMdd", "MMddyyyy")) -> Column:
    """First format that parses wins."""
    return F.coalesce(*[parse_date(str_col, f) for f in fmts])


def month_before(month: str, n: int) -> str:
    """The 'yyyy-MM' month n months earlier."""
    i = int(month[:4]) * 12 + int(month[5:7]) - 1 - n
    return f"{i // 12:04d}-{i % 12 + 1:02d}"


#: Formats whose text order is the order of the dates.
ORDERED_FORMATS = {"yyyyMMdd": "%Y%m%d", "yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d"}
#: Formats that end with the year.
YEAR_LAST_FORMATS = ("MMddyyyy", "ddMMyyyy", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy")


def string_date_window(col: str, fmt: str, start: str, end: str) -> Column:
    """Rows whose text ``col``, read as ``fmt``, is a date of the inclusive window ``start``..``end``.

    The exact test parses the text.  Beside it stands a coarser condition on
    the text itself that reaches the scan: bounds where the text order is the
    date order, the window's years as endings where the year stands last.  No
    text that parses into the window fails it, so malformed texts are judged
    by the exact test alone.
    """
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    exact = parse_date(col, fmt).between(F.lit(first), F.lit(last))
    if fmt in ORDERED_FORMATS:
        shape = ORDERED_FORMATS[fmt]
        return (F.col(col) >= first.strftime(shape)) & (F.col(col) <= last.strftime(shape)) & exact
    if fmt in YEAR_LAST_FORMATS:
        ends = None
        for year in range(first.year, last.year + 1):
            one = F.col(col).endswith(f"{year:04d}")
            ends = one if ends is None else ends | one
        return exact if ends is None else ends & exact
    return exact
