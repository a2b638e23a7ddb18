"""Reshaping: long -> wide, crosstab, row-wise totals and shares
(A12-A15, A23, A24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.exprs import row_total, safe_div
from cohortkit.session import materialize


def col_name(*parts) -> str:
    """Stable column name from category parts (non-alphanumerics -> '_')."""
    s = "_".join(str(p) for p in parts)
    return "".join(ch if ch.isalnum() else "_" for ch in s)


#: Most categories that become columns, as in the reference's setting.
MAX_CATEGORIES = 50_000
#: Up to so many output columns one aggregate has a conditional expression for each; beyond, categories are looked up.
CONDITIONAL_COLUMNS = 32
#: Up to so many categories rows of others are left out before they are collected.
LISTED = 1000


def categories(df: DataFrame, category: str, limit: int = MAX_CATEGORIES) -> list:
    """The domain pass of ``long_to_wide``: the sorted non-null values of ``category``, written once.

    More than ``limit`` values raise an error that names the column.
    """
    found = materialize(df.select(category).where(F.col(category).isNotNull()).distinct().limit(limit + 1), "categories")
    values = sorted(r[0] for r in found.collect())
    if len(values) > limit:
        raise ValueError(f"{category}: more than {limit} categories to turn into columns")
    return values


def long_to_wide(df: DataFrame, keys, category: str, measures, values=None, agg: str = "first",
                 prefix: str | None = None, fill=None) -> DataFrame:
    """One column per (value, measure), named ``[prefix_]<value>[_<measure>]``.

    The measure is part of the name only when there are several.  With
    ``values`` given, no job runs and the schema does not depend on the data;
    without, the domain pass finds them.  Rows of other categories are left
    out, but their keys stay.  ``fill`` replaces missing combinations.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    measures = [measures] if isinstance(measures, str) else list(measures)
    values = categories(df, category) if values is None else list(values)
    fn = {"first": lambda c: F.first(c, ignorenulls=True), "sum": F.sum, "max": F.max,
          "min": F.min, "count": F.count, "avg": F.avg}[agg]
    names = {(v, m): col_name(*([prefix] if prefix else []), v, *([m] if len(measures) > 1 else [])) for v in values for m in measures}
    if len(set(names.values())) < len(names):
        raise ValueError(f"{category}: values that differ only in punctuation would share a column")
    if len(names) <= CONDITIONAL_COLUMNS:
        out = df.groupBy(*keys).agg(*[fn(F.when(F.col(category) == F.lit(v), F.col(m))).alias(n) for (v, m), n in names.items()])
    else:
        per = df.groupBy(*keys, category).agg(*[fn(m).alias(m) for m in measures])
        # a key's few categories side by side as a map: a pivot's buffer has a place for each column
        entry = F.struct(F.col(category).alias("_key"), F.struct(*[F.col(m).alias(f"_{i}") for i, m in enumerate(measures)]).alias("_value"))
        listed = F.col(category).isNotNull() & (F.col(category).isin(values) if len(values) <= LISTED else F.lit(True))
        wide = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(listed, entry))).alias("_by_category"))
        out = wide.select(*keys, *[F.try_element_at("_by_category", F.lit(v))[f"_{i}"].alias(names[v, m])
                                   for v in values for i, m in enumerate(measures)])  # columns stand by value, then measure
    if agg == "count":
        fill = 0 if fill is None else fill
    if fill is not None:
        out = out.fillna(fill, [c for c in out.columns if c not in keys])
    return out


def pivot_counts(df: DataFrame, keys, category: str, values, prefix: str = "", suffix: str = "_CNT") -> DataFrame:
    """Counts per category, renamed and 0-filled."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum((F.col(category) == F.lit(v)).cast("long")), F.lit(0))
                                   .alias(col_name(prefix + str(v)) + suffix) for v in values])


def crosstab(df: DataFrame, row_col: str, col_col: str, col_values) -> DataFrame:
    """Contingency counts of two columns with explicit column values."""
    return pivot_counts(df, row_col, col_col, col_values, prefix=f"{col_col}_", suffix="")


def with_row_total(df: DataFrame, cols, name: str = "row_total") -> DataFrame:
    """Row-wise total across columns (nulls as 0)."""
    return df.withColumn(name, row_total(cols))


def row_shares(df: DataFrame, cols, suffix: str = "_share") -> DataFrame:
    """Each column divided by the row total (null when the total is 0)."""
    tot = row_total(cols)
    return df.select("*", *[safe_div(F.col(c), tot).alias(c + suffix) for c in cols])
