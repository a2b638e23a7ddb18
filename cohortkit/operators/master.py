"""Master table assembly and its checks.

Grain safety: instead of comparing row counts before and after every left
join (two full jobs per join), each right side carries an in-plan key check:
a count over a window partitioned by the join keys, and a filter that calls
``raise_error`` naming the offending key when the count exceeds 1.  The
window needs the same hash partitioning on the keys as the sort-merge join,
so the check adds no shuffle and no separate job; a left join against a
unique right side cannot change the spine's grain.

Join plan: tables of one row per actor come first, while the rows are narrow.
The others are joined on the same (actor, month) keys, so after that shuffle
the growing left side stays hash-partitioned on those keys and later
sort-merge joins only shuffle the feature side (AQE may broadcast a small
one).  Wide families of features travel as one map column each and are laid
out after the last join: no wide row is shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.exprs import any_positive
from cohortkit.operators.distinct import distinct_by_kind


class DuplicateKeyError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """(keys, n) for keys occurring more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys, name: str = "table", sample: int = 5) -> DataFrame:
    """Raise with up to ``sample`` offending keys when ``keys`` is not unique."""
    bad = duplicate_keys(df, keys).limit(sample).collect()
    if bad:
        raise DuplicateKeyError(f"{name}: duplicate keys {list(keys)}: " + "; ".join(str(r.asDict()) for r in bad))
    return df


def guard_unique(df: DataFrame, keys, name: str = "table") -> DataFrame:
    """Lazily fail the job with the offending key if ``keys`` is not unique."""
    keys = list(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    msg = F.concat(F.lit(f"{name}: duplicate key "), F.to_json(F.struct(*keys)))
    return (df.withColumn("_key_n", n)
              .filter(F.when(F.col("_key_n") > 1, F.raise_error(msg)).otherwise(F.lit(True)))
              .drop("_key_n"))


def master_table(spine: DataFrame, features, keys=("actor_id", "cohort_month"), fill=0,
                 check: bool = True, never_fill=("org_id",), grouped=(), expand: dict | None = None) -> DataFrame:
    """Spine ⟕ each feature table (on ``keys`` or a subset), then fill.

    ``features`` is a list of (name, DataFrame, join_keys or None).  Feature
    columns that collide with spine columns are rejected.  Identifiers
    (``never_fill``) stay null where missing: 0 may be a real one.

    Every right side is checked for unique keys, except those named in
    ``grouped``: results of an aggregate over exactly the join keys, which
    Spark also joins by the shuffle of that aggregate.

    ``expand`` names columns that hold many features in one (a map or array)
    and the expressions that lay them out; that is done after the last join.
    """
    keys, expand = list(keys), expand or {}
    features = [(name, df, list(jk or keys)) for name, df, jk in features]
    order = [*spine.columns, *(c for _, df, jk in features for c in df.columns if c not in jk)]
    out = spine
    # fewer keys first, while the rows are narrow: the widest grain's partitioning then stays to the end
    for name, df, jk in sorted(features, key=lambda f: len(f[2])):
        clash = (set(df.columns) - set(jk)) & set(out.columns)
        if clash:
            raise ValueError(f"{name}: columns already present: {sorted(clash)}")
        if check and name not in grouped:
            df = guard_unique(df, jk, name)
        out = out.join(df, jk, "left")
    out = out.select(*[x for c in order for x in expand.get(c, [c])])
    if len(set(out.columns)) < len(out.columns):
        raise ValueError(f"columns already present: {sorted(c for c in set(out.columns) if out.columns.count(c) > 1)}")
    if fill is not None:
        out = out.fillna(fill, [c for c in out.columns if c not in keys and c not in never_fill])
    return out


def label_balance(df: DataFrame, label: str = "target") -> DataFrame:
    """Class counts."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def id_coverage(spine: DataFrame, feats: DataFrame, id_col: str = "actor_id", label: str = "target",
                month_col: str = "cohort_month") -> DataFrame:
    """Spine ids also present in a feature table: overlap size, class
    counts and month range on the overlap (one aggregate)."""
    ov = spine.join(feats.select(id_col).distinct(), id_col, "left_semi")
    kinds = {"n_overlap_ids": F.lit(True), "n_overlap_positive": F.col(label) == 1, "n_overlap_negative": F.col(label) == 0}
    return distinct_by_kind(ov, [], id_col, kinds, {"first_month": (F.min, F.col(month_col)), "last_month": (F.max, F.col(month_col))})


def feature_stats_monthly(df: DataFrame, month_col: str, cols) -> DataFrame:
    """Per month count, mean, stddev, min, max and sum of every feature."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum")]
    return df.groupBy(month_col).agg(*aggs)


def rows_with_any_positive(df: DataFrame, cols) -> DataFrame:
    """Rows where any of the numeric columns is > 0."""
    return df.filter(any_positive(cols))


def new_actor_history(events: DataFrame, spine: DataFrame, label: str = "target") -> DataFrame:
    """Full event history of the positive spine actors (semi-join)."""
    pos = spine.filter(F.col(label) == 1).select("actor_id")
    return events.join(pos, "actor_id", "left_semi")
