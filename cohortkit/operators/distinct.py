"""Distinct counts of many kinds at once, without multiplying the rows.

``count(DISTINCT CASE WHEN ...)`` repeated over k conditions makes the
planner copy every row k times before the shuffle.  Two levels of plain
aggregates do the same: first one row for each id (with a bit for every kind
it was seen in), then sums of bits.  Both levels combine before they shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in one long bit set.
BITS = 62


def _words(kinds: dict[str, Column]) -> list[list[tuple[int, str, Column]]]:
    listed = [(i % BITS, name, cond) for i, (name, cond) in enumerate(kinds.items())]
    return [listed[k:k + BITS] for k in range(0, len(listed), BITS)]


def distinct_by_kind(df: DataFrame, keys, id_col: str, kinds: dict[str, Column], carry: dict[str, tuple] | None = None) -> DataFrame:
    """Per ``keys``: for every kind the number of distinct non-null ids with a row that meets its condition.

    ``carry`` adds other aggregates in the same two passes: name -> (function
    of both levels, column), for functions that combine with themselves
    (``F.sum``, ``F.min``, ``F.max``).  A null condition is not met.
    """
    keys, carry = list(keys), carry or {}
    words = _words(kinds)
    masks = [reduce(Column.bitwiseOR, [F.when(cond, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, _, cond in word])
             for word in words]
    per_id = df.groupBy(*keys, F.col(id_col).alias("_id")).agg(
        *[F.bit_or(m).alias(f"_kinds_{k}") for k, m in enumerate(masks)], *[fn(col).alias(name) for name, (fn, col) in carry.items()])
    counts = [F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.shiftright(f"_kinds_{k}", bit).bitwiseAND(F.lit(1)))), F.lit(0)).alias(name)
              for k, word in enumerate(words) for bit, name, _ in word]
    return per_id.groupBy(*keys).agg(*counts, *[fn(name).alias(name) for name, (fn, _) in carry.items()])


def distinct_each(df: DataFrame, keys, columns: dict[str, str]) -> DataFrame:
    """Per ``keys``: the number of distinct non-null values of each of ``columns`` (name -> column).

    The distinct combinations are shuffled once; every column is counted from
    that one shuffle.  Without keys: one row.
    """
    keys = list(keys)
    base = df.select(*keys, *dict.fromkeys(columns.values())).distinct()
    parts = []
    for name, col in columns.items():
        one = base.select(*keys, F.col(col).alias("_v")).distinct().groupBy(*keys).agg(F.count("_v").alias(name))
        parts.append(one.select(*keys, *[(F.col(n) if n == name else F.lit(None).cast("long")).alias(n) for n in columns]))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.max(n).alias(n) for n in columns])
