"""Generic row-level expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_true(conds) -> Column:
    """OR-fold of predicates (False for an empty list)."""
    conds = list(conds)
    return reduce(or_, conds) if conds else F.lit(False)


def all_true(conds) -> Column:
    conds = list(conds)
    return reduce(and_, conds) if conds else F.lit(True)


def any_null(cols) -> Column:
    return any_true(F.col(c).isNull() for c in cols)


def any_positive(cols) -> Column:
    return any_true(F.coalesce(F.col(c) > 0, F.lit(False)) for c in cols)


def safe_div(num, den) -> Column:
    """Division that yields null on a zero divisor instead of raising under ANSI."""
    return F.try_divide(num, den)


def null_safe_eq(col, value) -> Column:
    """``col <=> value`` as a boolean that is never null."""
    return F.col(col).eqNullSafe(F.lit(value)) if isinstance(col, str) else col.eqNullSafe(F.lit(value))


def recode_use(col, unknown_as: str = "1", null_as: str | None = None) -> Column:
    """Normalise a use flag ('0' / '1' / 'UNK' / null).

    ``unknown_as='1'``: null and UNK become '1' (share features);
    ``unknown_as='0'``: UNK becomes '0', null stays null (timelines);
    ``unknown_as='binary'``: '0' -> '0', anything else -> '1'.
    """
    c = F.col(col) if isinstance(col, str) else col
    if unknown_as == "binary":
        return F.when(c == "0", F.lit("0")).otherwise(F.lit("1"))
    nul = unknown_as if null_as is None else null_as
    if unknown_as == "1":
        return F.when(c.isNull() | (c == "UNK"), F.lit("1")).otherwise(c)
    return F.when(c == "UNK", F.lit(unknown_as)).when(c.isNull(), F.lit(nul)).otherwise(c)


def row_total(cols) -> Column:
    """Row-wise sum with nulls as 0."""
    cols = list(cols)
    return reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in cols]) if cols else F.lit(0)


def r6(c) -> Column:
    """Round a double to 6 places (stable comparison across engines)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def listed_class(column: str, classes):
    """The class, null as UNKNOWN; a class that is not in ``classes`` is OTHER where that is listed, else it fails the job."""
    cls = F.coalesce(F.col(column), F.lit("UNKNOWN"))
    beyond = F.lit("OTHER") if "OTHER" in classes else F.when(
        cls != "UNKNOWN", F.raise_error(F.concat(F.lit("class not listed: "), cls)).cast("string"))
    return F.when(cls.isin(*classes), cls).otherwise(beyond)
