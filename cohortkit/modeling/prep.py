"""Split, scale, resample and weight.

Resampling is exact and deterministic without sorting a whole class in one
task: rows are ordered by ``md5(key || seed)``; the hash space is cut into
65,536 buckets by its first four hex digits, bucket sizes are counted (a
bounded aggregate), and only the single boundary bucket is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def temporal_split(df: DataFrame, month_col: str, train_end: str):
    """M1: train = month <= train_end, test = later months."""
    return df.filter(F.col(month_col) <= train_end), df.filter(F.col(month_col) > train_end)


def with_split(df: DataFrame, month_col: str, train_end: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(month_col) <= train_end, "train").otherwise("test"))


def expanding_month_splits(df: DataFrame, month_col: str, n_splits: int) -> DataFrame:
    """Expanding time-ordered folds over distinct months.

    Months are numbered 0..M-1 and size = M // (n + 1).  The n validation
    blocks are the last n * size months, the remainder belongs to the first
    training block; fold k (1..n) validates on block k and trains on every
    earlier month, so each month is in some fold.  Returns per fold the row
    counts and month ranges.  The month list is bounded by the calendar.
    """
    months = df.select(month_col).distinct()
    everything = Window.partitionBy()
    mi = (months.withColumn("_i", F.dense_rank().over(Window.orderBy(month_col)) - 1)
                .withColumn("_m", F.count(F.lit(1)).over(everything)))
    size = F.greatest(F.floor(F.col("_m") / (n_splits + 1)), F.lit(1))
    start = F.col("_m") - n_splits * size
    # months x folds, both bounded by the calendar: generated per month row
    roles = (mi.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
               .withColumn("role", F.when(F.col("_i") < start + (F.col("fold") - 1) * size, "train")
                           .when(F.col("_i") < start + F.col("fold") * size, "valid"))
               .filter(F.col("role").isNotNull()))
    per_month = df.groupBy(month_col).agg(F.count(F.lit(1)).alias("_n"))
    j = roles.join(per_month, month_col)
    return (j.groupBy("fold")
             .agg(F.sum(F.when(F.col("role") == "train", F.col("_n"))).alias("n_train"),
                  F.sum(F.when(F.col("role") == "valid", F.col("_n"))).alias("n_valid"),
                  F.min(F.when(F.col("role") == "train", F.col(month_col))).alias("train_from"),
                  F.max(F.when(F.col("role") == "train", F.col(month_col))).alias("train_to"),
                  F.min(F.when(F.col("role") == "valid", F.col(month_col))).alias("valid_from"),
                  F.max(F.when(F.col("role") == "valid", F.col(month_col))).alias("valid_to")))


#: Columns whose statistics are taken in one aggregate: the code of many more is too long to be compiled.
STATS_COLUMNS = 24


def fit_scaler(train: DataFrame, cols) -> DataFrame:
    """M2: one-row table of mean and population stddev per column.

    Wide frames are aggregated a group of columns at a time, each group from
    its own columns of the (written) rows; the one-row results are put side by side.
    """
    cols, out = list(cols), None
    for i in range(0, max(len(cols), 1), STATS_COLUMNS):
        aggs = []
        for c in cols[i:i + STATS_COLUMNS]:
            aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
        part = train.agg(*aggs)
        out = part if out is None else out.crossJoin(part)
    return out


def apply_scaler(df: DataFrame, stats: DataFrame, cols) -> DataFrame:
    """M2: (x - mean) / std with the fitted one-row stats (std 0 -> null)."""
    row = stats.first().asDict()  # one row, 2 numbers per column: bounded
    st = {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in cols}
    out = [F.try_divide(F.col(c) - F.lit(st[c][0]), F.lit(st[c][1])).alias(c) if c in st else F.col(c)
           for c in df.columns]
    return df.select(*out)


def _hash(key_cols, seed: int):
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols], F.lit(str(seed))))


def take_first_by_hash(df: DataFrame, n, key_cols, seed: int) -> DataFrame:
    """Exactly the ``n`` rows with the smallest md5(key || seed) (ties by key).

    ``n`` may be a Column (scalar subquery).  Only the boundary bucket is
    ranked row by row.
    """
    h = df.withColumn("_h", _hash(key_cols, seed)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_bn"))
    # bounded: at most 65,536 bucket rows
    cum = sizes.withColumn("_before", F.coalesce(F.sum("_bn").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n_col = n if not isinstance(n, int) else F.lit(n)
    tagged = h.join(cum.select("_b", "_bn", "_before"), "_b").filter(F.col("_before") < n_col)
    whole = tagged.filter(F.col("_before") + F.col("_bn") <= n_col)
    w = Window.partitionBy("_b").orderBy("_h", *key_cols)
    ranked = (tagged.filter(F.col("_before") + F.col("_bn") > n_col)
              .withColumn("_r", F.col("_before") + F.row_number().over(w)).filter(F.col("_r") <= n_col).drop("_r"))
    return whole.unionByName(ranked).drop("_h", "_b", "_bn", "_before")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def undersample(df: DataFrame, label: str, key_cols, seed: int) -> DataFrame:
    """M4: every class cut to the minority size, keeping the smallest hashes."""
    n_min = class_counts(df, label).agg(F.min("n")).scalar()
    classes = [r[0] for r in df.select(label).distinct().collect()]  # label values: a handful
    parts = [take_first_by_hash(df.filter(F.col(label) == v), n_min, key_cols, seed) for v in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oversample(df: DataFrame, label: str, key_cols, seed: int) -> DataFrame:
    """M3: every class grown to the majority size: each row once, then whole
    extra copies, then the first ``remainder`` rows by hash.  Adds ``copy``."""
    counts = {r[0]: r[1] for r in class_counts(df, label).collect()}  # one row per class
    n_max = max(counts.values())
    out = None
    for v, n in counts.items():
        part = df.filter(F.col(label) == v)
        k, r = divmod(n_max - n, n)
        reps = part.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k))))
        if r:
            extra = take_first_by_hash(part, r, key_cols, seed).withColumn("copy", F.lit(k + 1))
            reps = reps.unionByName(extra)
        out = reps if out is None else out.unionByName(reps)
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M5: balanced weights n / (n_classes * n_class)."""
    everything = Window.partitionBy()  # over one row per class
    total, k = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    cnt = class_counts(df, label)
    return cnt.select(label, "n", (total / (k * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)  # one row per class


def with_positive_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Weight n / (2 p) for positives and 1 for the others."""
    ratio = df.agg(F.count(F.lit(1)) / (2 * F.sum((F.col(label) == 1).cast("long")))).scalar()
    return df.withColumn(weight_col, F.when(F.col(label) == 1, ratio).otherwise(1.0))
