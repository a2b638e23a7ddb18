"""Data quality, profiling and exploration operators (D1-D8, D10-D13, D51,
A3, A6-A9, A17, P14, P17).

All profiles are single-pass aggregates.  Wide per-column statistics are
computed by unpivoting once (``stack``) and grouping by (column, value), so
the work is one shuffle no matter how many columns there are.  Top-k per
column is done in two levels (salted partial top-k, then a final top-k over
at most ``k * salts`` candidates) so a high-cardinality column never lands in
one window partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.exprs import any_null
from cohortkit.operators.distinct import distinct_by_kind, distinct_each
from cohortkit.session import materialize


def find_conflicting(df: DataFrame, id_col: str, attr_col: str) -> DataFrame:
    """Ids with more than one distinct non-null attribute value."""
    return (df.groupBy(id_col)
              .agg(F.countDistinct(attr_col).alias("n_values"))
              .filter(F.col("n_values") > 1))


def drop_conflicting(df: DataFrame, id_col: str, attr_col: str) -> DataFrame:
    """Remove every row of a conflicting id (anti-join, no key list on the driver)."""
    return df.join(find_conflicting(df, id_col, attr_col).select(id_col), id_col, "left_anti")


def clean_events(events: DataFrame, keep_cols, id_col: str, attr_col: str,
                 fill: dict | None = None, rename: dict | None = None,
                 move_after: tuple[str, str] | None = None) -> DataFrame:
    """Shortlist, fill codes, remove conflicted ids, rename and reorder."""
    df = events.select(*keep_cols)
    if fill:
        df = df.fillna(fill)
    df = drop_conflicting(df, id_col, attr_col)
    if rename:
        df = df.withColumnsRenamed(rename)
    if move_after:
        df = df.select(*reorder_after(df.columns, *move_after))
    return df


def reorder_after(columns, col: str, after: str | None):
    """Column list with ``col`` moved right after ``after`` (front when None)."""
    rest = [c for c in columns if c != col]
    if after is None:
        return [col] + rest
    i = rest.index(after)
    return rest[: i + 1] + [col] + rest[i + 1:]


def source_mismatch(df: DataFrame, id_col: str, col_a: str, col_b: str) -> DataFrame:
    """D3: per id, rows where both sources are non-null and differ, and whether
    the id has the maximum such count (join back to the arg-max)."""
    bad = df.filter(F.col(col_a).isNotNull() & F.col(col_b).isNotNull() & (F.col(col_a) != F.col(col_b)))
    per = bad.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_mismatch"))
    mx = per.agg(F.max("n_mismatch")).scalar()  # scalar subquery
    return per.select(id_col, "n_mismatch", (F.col("n_mismatch") == mx).cast("int").alias("is_max"))


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """Groups of identical rows (nulls equal) with their count > 1."""
    cols = list(cols or df.columns)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_copies")).filter(F.col("n_copies") > 1)


def _long_values(df: DataFrame, cols) -> DataFrame:
    """Unpivot to (column_name, value) with values as strings."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value")


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(column_name, value, n) over all columns at once, nulls kept as a value."""
    return _long_values(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _top_from_counts(cnt: DataFrame, k: int, salts: int) -> DataFrame:
    order = [F.desc("n"), F.asc("value")]
    salted = cnt.filter(F.col("value").isNotNull()).withColumn("_s", F.abs(F.xxhash64("value")) % salts)
    part = salted.withColumn("_r", F.row_number().over(
        Window.partitionBy("column_name", "_s").orderBy(*order))).filter(F.col("_r") <= k)
    return (part.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(*order)))
                .filter(F.col("rank") <= k).select("column_name", "rank", "value", "n"))


def top_values(df: DataFrame, cols, k: int = 3, salts: int = 64) -> DataFrame:
    """K most frequent non-null values per column (ties by value), as rows.

    Two-level top-k: rank inside (column, hash(value) % salts) then over the
    <= k * salts survivors per column, so a high-cardinality column never
    lands in one window partition.
    """
    return _top_from_counts(value_counts(df, cols), k, salts)


def table_profile(df: DataFrame, cols=None, k: int = 3, salts: int = 64) -> DataFrame:
    """Per column null %, distinct count and the top-k values joined by ', '.

    One scan: the (column, value) counts feed the totals, the null and
    distinct counts and the top-k (the shared subtree's shuffle is reused).
    """
    cols = list(cols or df.columns)
    cnt = value_counts(df, cols)
    stats = cnt.groupBy("column_name").agg(
        F.sum("n").alias("_total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.when(F.col("value").isNotNull(), F.lit(1))).alias("n_distinct"))
    top = (_top_from_counts(cnt, k, salts).groupBy("column_name")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                                         lambda x: x["value"]), ", ").alias("top_values")))
    return (stats.join(top, "column_name", "left")
            .select("column_name", F.round(F.col("n_null") * 100.0 / F.col("_total"), 6).alias("null_pct"),
                    "n_distinct", "top_values"))


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Null count and percent per column, one aggregate pass."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = agg.unpivot(["_total"], cols, "column_name", "n_null")
    return long.select("column_name", "n_null",
                       F.round(F.col("n_null") * 100.0 / F.col("_total"), 6).alias("null_pct"))


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """A3: several exact distinct counts in one row."""
    return distinct_each(df, [], {f"n_{c}": c for c in cols})


def rows_with_nulls(df: DataFrame, cols=None) -> DataFrame:
    """Rows where any of the columns is null."""
    return df.filter(any_null(cols or df.columns))


def drop_all_null_columns(df: DataFrame, cols=None):
    """Names of the columns that are entirely null (one aggregate pass).

    Returns the DataFrame of names; ``select_non_null_columns`` applies it.
    """
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count(c).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "n_non_null").filter(F.col("n_non_null") == 0)


def select_non_null_columns(df: DataFrame) -> DataFrame:
    """P14 applied: reads back the (tiny, one row per column) null report."""
    empty = {r["column_name"] for r in drop_all_null_columns(df).collect()}
    return df.select(*[c for c in df.columns if c not in empty])


def describe_numeric(df: DataFrame, cols=None) -> DataFrame:
    """Count, mean, sample stddev, min, max per numeric column, as rows."""
    num = {"int", "bigint", "smallint", "tinyint", "double", "float"}
    cols = list(cols or [c for c, t in df.dtypes if t in num or t.startswith("decimal")])
    def measures(c):
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column_name"), F.count(v).alias("count"), F.avg(v).alias("mean"),
                        F.stddev_samp(v).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"))

    # one row of aggregates, turned round afterwards: the rows themselves are not multiplied
    return df.agg(F.array(*[measures(c) for c in cols]).alias("_m")).select(F.explode("_m").alias("m")).select("m.*")


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Percent of records per value (share of the grand total)."""
    cnt = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = cnt.agg(F.sum("n")).scalar()  # a scalar subquery over the counts, whose shuffle is reused
    return cnt.withColumn("pct", F.col("n") * 100.0 / total)


def source_switch(df: DataFrame, id_col: str, col_a: str, col_b: str, source_col: str,
                  excluded_source: str) -> DataFrame:
    """Per id, 1 if any row has ``col_a <> col_b`` outside the excluded source."""
    flag = (F.col(col_a) != F.col(col_b)) & (F.col(source_col) != excluded_source)
    return df.groupBy(id_col).agg(F.max(F.coalesce(flag, F.lit(False)).cast("int")).alias("switch_flag"))


def monthly_quantity(events: DataFrame, product: str | None = None) -> DataFrame:
    """Total quantity per month, optionally of one product."""
    ev = events if product is None else events.filter(F.col("product") == product)
    return ev.groupBy("month").agg(F.sum("quantity").alias("total_quantity"))


def monthly_subjects(events: DataFrame, product: str) -> DataFrame:
    """Distinct subjects of a product per month."""
    return (events.filter(F.col("product") == product).groupBy("month")
                  .agg(F.countDistinct("subject_id").alias("n_subjects")))


def product_reach(events: DataFrame, by=("product",)) -> DataFrame:
    """Distinct actors and subjects per product (and source)."""
    return distinct_each(events, by, {"n_actors": "actor_id", "n_subjects": "subject_id"})


def relationship_degree(events: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct ``right`` per ``left`` with a dense rank (most first)."""
    per = events.groupBy(left).agg(F.countDistinct(right).alias("n_distinct"))
    # rank the distinct counts (a small set), then join back: no unpartitioned window over ids
    ranks = (per.select("n_distinct").distinct()
                .withColumn("degree_rank", F.dense_rank().over(Window.orderBy(F.desc("n_distinct")))))
    return per.join(ranks, "n_distinct").select(left, "n_distinct", "degree_rank")


def match_coverage(left: DataFrame, right: DataFrame, keys, since_col: str, since: str,
                   left_ids=("subject_id", "actor_id")) -> DataFrame:
    """Rows / distinct ids of ``left`` matched in ``right`` on ``keys``.

    ``keys`` is a list of (left_col, right_col).  Matched row count of the
    many-to-many join is the sum over keys of n_left * n_right, computed from
    per-key aggregates so no pair is ever materialised.
    """
    lk = [a for a, _ in keys]
    r = right.groupBy(*[F.col(b).alias(a) for a, b in keys]).agg(F.count(F.lit(1)).alias("_nr"))
    since_c = F.coalesce(F.col(since_col) >= F.to_date(F.lit(since)), F.lit(False))
    # the rows that meet, written narrow: totals and each id's distinct values combine before they shuffle
    met = materialize(left.join(r, lk, "inner").select(*left_ids, since_c.cast("int").alias("_since"), F.col("_nr").alias("_rows")), "matched")
    since_rows = F.when(F.col("_since") == 1, F.col("_rows"))
    parts = [met.agg(F.sum("_rows").alias("matched_rows"), F.sum(since_rows).alias("matched_rows_since"))]
    for c in left_ids:
        one = met.groupBy(F.col(c).alias("_id")).agg(F.max("_since").alias("_since")).where("_id is not null")
        parts.append(one.agg(F.count(F.lit(1)).alias(f"matched_{c}"), F.count(F.when(F.col("_since") == 1, 1)).alias(f"matched_{c}_since")))
    names = [n for p in parts for n in p.columns]
    rows = reduce(DataFrame.unionByName, [p.select(*[F.col(n) if n in p.columns else F.lit(None).cast("long").alias(n) for n in names])
                                          for p in parts])
    return rows.agg(*[F.max(n).alias(n) for n in names]).fillna(0, ["matched_rows_since"])


def dimension_coverage(facts: DataFrame, fact_key: str, dim: DataFrame, dim_key: str,
                       dim_attr: str) -> DataFrame:
    """Distinct fact ids, and how many have a dimension row with a non-null attribute."""
    d = dim.select(F.col(dim_key).alias(fact_key), F.col(dim_attr).alias("_attr"))
    j = facts.select(fact_key).distinct().join(d, fact_key, "left")  # dedupe before the join
    found = distinct_by_kind(j, [], fact_key, {"n_ids": F.lit(True), "n_matched": F.col("_attr").isNotNull()})
    return found.withColumn("share", F.try_divide("n_matched", "n_ids"))


def sample_one_id(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """All rows of one id chosen by a seeded hash order (deterministic)."""
    pick = (df.select(id_col).distinct()
              .orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))), id_col)
              .limit(1))
    return df.join(pick, id_col, "left_semi")
