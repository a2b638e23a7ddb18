"""Time axis, dense panels and trailing-window features (D23-D26, D42, D47,
D48, W1, W9-W11).

Densifying: every id row generates its own periods with
``explode(sequence(lo, hi))`` — no cross join, no broadcast, and the output
is exactly ids x periods.  Facts are aggregated to (id, period) *before* the
left join, so each window partition holds at most one row per period: the
window cost per id is bounded by the length of the time axis, whatever the
skew of the raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.dates import month_from_index, month_index, month_index_of_str
from cohortkit.functions.exprs import listed_class
from cohortkit.operators.distinct import distinct_by_kind


def densify_ids(ids: DataFrame, id_cols, period_name: str, lo, hi, step: str | None = None) -> DataFrame:
    """ids x periods in [lo, hi] (ints, or dates with ``step`` like 'interval 1 day')."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    seq = F.sequence(lo, hi) if step is None else F.sequence(lo, hi, F.expr(step))
    return ids.select(*id_cols, F.explode(seq).alias(period_name))


def dense_panel(facts: DataFrame, id_col: str, period_col: str, value_cols, lo, hi,
                step: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, period) facts made dense over [lo, hi] for every id; missing -> 0."""
    value_cols = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    base = ids if ids is not None else facts.select(id_col).distinct()
    grid = densify_ids(base, id_col, period_col, lo, hi, step)
    return grid.join(facts, [id_col, period_col], "left").fillna(0, value_cols)


def trailing_sums(panel: DataFrame, id_col: str, order_col: str, value_cols, sizes=(1, 3, 6, 9, 12),
                  prefix: str = "prev", drop_current: bool = True) -> DataFrame:
    """Sum over the previous k rows (current excluded); first row -> 0.

    All window columns share one partition/order spec, so Spark evaluates
    them in a single Window operator (one sort per id).
    """
    value_cols = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    w = Window.partitionBy(id_col).orderBy(order_col)
    new = []
    for v in value_cols:
        for k in sizes:
            new.append(F.coalesce(F.sum(v).over(w.rowsBetween(-k, -1)), F.lit(0))
                       .alias(f"{prefix}_{k:02d}_{v}"))
    keep = [c for c in panel.columns if not (drop_current and c in value_cols)]
    return panel.select(*keep, *new)


def trailing_mean_with_leading_zero(value: str, id_col: str, order_col: str, n: int = 12) -> Column:
    """Mean of the previous <= n values where a synthetic leading 0 counts in
    the divisor: sum(rows -n..-1) / least(row_number, n)."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    s = F.coalesce(F.sum(value).over(w.rowsBetween(-n, -1)), F.lit(0))
    return s / F.least(F.row_number().over(w), F.lit(n))


def bucket_of_gap(gap: Column, edges=(1, 3, 6, 9, 12), cumulative: bool = False) -> Column:
    """Disjoint recency bucket of a month gap: (0,1] LAST_1M, (1,3] LAST_3M, ...

    Gaps <= 0 or beyond the last edge give null (dropped by the caller).
    ``cumulative=True`` is handled by ``cohorts_of`` (one row per bucket
    whose upper edge covers the gap).
    """
    expr = None
    lo = 0
    for e in edges:
        cond = (gap > lo) & (gap <= e)
        expr = F.when(cond, F.lit(f"LAST_{e}M")) if expr is None else expr.when(cond, F.lit(f"LAST_{e}M"))
        lo = e
    return expr


#: Columns that ``cohorts_of`` adds, all integers: the cohort's month index, the gap in months, the bucket's upper edge.
COHORT, GAP, EDGE = "cohort_index", "month_gap", "bucket_edge"


#: Column with the cohort months that an actor's rows are asked for.
WANTED = "_wanted"


def wanted_cohorts(spine: DataFrame, first_month: str) -> DataFrame:
    """Per actor the cohort months of its spine rows, as the bits of months since ``first_month`` (the last bit: any later month)."""
    lo = month_index_of_str(F.lit(first_month))
    bit = F.least(F.greatest(month_index_of_str(F.col("cohort_month")) - lo, F.lit(0)), F.lit(62))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return (spine.filter(F.col("actor_id").isNotNull() & F.col("cohort_month").isNotNull())
                 .groupBy("actor_id").agg(mask.alias("mask")).select("actor_id", F.struct(lo.alias("lo"), "mask").alias(WANTED)))


def carried(df: DataFrame) -> list[str]:
    """The key that steps before a fan-out carry along, where rows have it."""
    return [WANTED] if WANTED in df.columns else []


def is_wanted(index: Column) -> Column:
    """Whether the month of this index may be a cohort month of the actor's spine rows."""
    bit = F.least(F.greatest(index - F.col(WANTED)["lo"], F.lit(0)), F.lit(62))
    return F.call_function("shiftright", F.col(WANTED)["mask"], bit).bitwiseAND(F.lit(1)) == 1


def cohorts_of(df: DataFrame, month_col: str, lag: int, cohort_lo: str, cohort_hi: str,
               edges=(1, 3, 6, 9, 12), cumulative: bool = False) -> DataFrame:
    """J3 / J6 / D25 / D26 redesigned: attach to each row the cohort months it
    informs, i.e. c with 0 < (c - lag) - m <= max(edges), restricted to
    [cohort_lo, cohort_hi], and the recency bucket of the gap.

    At most max(edges) rows per input row instead of joining every row to
    every cohort month and filtering; rows with a ``WANTED`` column are spread
    over those months only, and the column is dropped.  The added columns are integers, so
    rows are grouped by numbers; ``named_cohorts`` names what is left.
    """
    h = max(edges)
    m = month_index_of_str(F.col(month_col)) if dict(df.dtypes)[month_col] == "string" \
        else month_index(F.col(month_col))
    lo_c = F.greatest(F.col("_m") + lag + 1, month_index_of_str(F.lit(cohort_lo)))
    hi_c = F.least(F.col("_m") + lag + h, month_index_of_str(F.lit(cohort_hi)))
    # rows informing no cohort in range are dropped first: sequence(a, b) with
    # a > b would count downwards
    out = (df.withColumn("_m", m)
             .filter(lo_c <= hi_c)
             .withColumn(COHORT, F.explode(F.sequence(lo_c, hi_c)))
             .withColumn(GAP, F.col(COHORT) - lag - F.col("_m")).drop("_m"))
    if carried(df):
        out = out.filter(is_wanted(F.col(COHORT))).drop(WANTED)
    if cumulative:
        return out.withColumn(EDGE, F.explode(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col(GAP) <= e)))
    edge = None
    for e in edges:
        edge = F.when(F.col(GAP) <= e, F.lit(e)) if edge is None else edge.when(F.col(GAP) <= e, F.lit(e))
    return out.withColumn(EDGE, edge)


def recency_counts(events: DataFrame, lag: int, cohort_lo: str, cohort_hi: str, edges=(1, 3, 6, 9, 12),
                   cumulative: bool = False) -> DataFrame:
    """Events and distinct subjects per actor, cohort and recency bucket with events.

    The rows are dealt by actor once, before the fan-out, and every later step
    groups within an actor.  A subject counts in a bucket through its latest
    month there: the one whose next month with the subject, seen from the
    cohort, is nearer than the bucket.  So no set of subjects is built, and
    cumulative buckets are sums over the gaps of a cohort, not row copies.
    """
    per = (events.select("actor_id", "subject_id", "month").repartition("actor_id")
                 .groupBy("actor_id", "subject_id", "month").agg(F.count(F.lit(1)).alias("_n")))
    index = month_index_of_str(F.col("month"))
    later = F.lead(index).over(Window.partitionBy("actor_id", "subject_id").orderBy(index))
    rows = per.select("actor_id", "month", "_n", F.col("subject_id").isNotNull().alias("_named"), (later - index).alias("_until_next"))
    fan = cohorts_of(rows, "month", lag, cohort_lo, cohort_hi, edges)
    gap, sums = F.col(GAP), []
    low = 0
    for i, e in enumerate(edges):
        inside = (gap <= e) if cumulative else (gap > low) & (gap <= e)
        nearest = 0 if cumulative else low
        latest = F.col("_until_next").isNull() | (gap - F.col("_until_next") <= nearest)
        sums += [F.sum(F.when(inside, F.col("_n"))).alias(f"_events_{i}"),
                 F.sum(F.when(inside & latest & F.col("_named"), 1).otherwise(0)).alias(f"_subjects_{i}")]
        low = e
    wide = fan.groupBy("actor_id", COHORT).agg(*sums)
    buckets = F.array(*[F.struct(F.lit(e).alias(EDGE), F.col(f"_events_{i}").alias("n_events"), F.col(f"_subjects_{i}").alias("n_subjects"))
                        for i, e in enumerate(edges)])
    return (wide.select("actor_id", COHORT, F.explode(F.filter(buckets, lambda b: b["n_events"].isNotNull())).alias("_b"))
                .select("actor_id", COHORT, "_b.*"))


def cohort_month() -> Column:
    """The 'yyyy-MM' name of a cohort index."""
    return month_from_index(F.col(COHORT)).alias("cohort_month")


def bucket_name() -> Column:
    """The recency bucket's name."""
    return F.concat(F.lit("LAST_"), F.col(EDGE).cast("string"), F.lit("M")).alias("bucket")


def fan_out_cohorts(df: DataFrame, month_col: str, lag: int, cohort_lo: str, cohort_hi: str,
                    edges=(1, 3, 6, 9, 12), cumulative: bool = False) -> DataFrame:
    """``cohorts_of`` with the cohort month and the bucket by name."""
    out = cohorts_of(df, month_col, lag, cohort_lo, cohort_hi, edges, cumulative)
    return out.select(*[c for c in df.columns if c != WANTED], GAP, bucket_name(), cohort_month())


def rolling_stddev(panel: DataFrame, id_col: str, order_col: str, value_cols, n: int = 4) -> DataFrame:
    """Sample stddev of the previous n rows (current excluded); 1 row -> null."""
    w = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(-n, -1)
    return panel.select("*", *[F.stddev_samp(v).over(w).alias(f"std_{n}_{v}") for v in value_cols])


def use_type_rates(events: DataFrame, flags: dict, id_col: str = "actor_id",
                   period_col: str = "month") -> DataFrame:
    """Per (id, period) count and share of rows meeting each flag condition."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for name, cond in flags.items():
        aggs.append(F.sum(F.coalesce(cond, F.lit(False)).cast("long")).alias(f"{name}_cnt"))
    g = events.groupBy(id_col, period_col).agg(*aggs)
    return g.select(id_col, period_col,
                    *[F.col(f"{k}_cnt") for k in flags],
                    *[(F.col(f"{k}_cnt") / F.col("_n")).alias(f"{k}_pct") for k in flags])


def use_type_trailing(rates: DataFrame, flags, first_month: str, last_month: str,
                      id_col: str = "actor_id", n: int = 12) -> DataFrame:
    """Dense over id x months; trailing n sum of counts (W10) and the
    leading-zero mean of shares (W11)."""
    r = rates.withColumn("_mi", month_index_of_str("month")).drop("month")
    cnts = [f"{k}_cnt" for k in flags]
    pcts = [f"{k}_pct" for k in flags]
    panel = dense_panel(r, id_col, "_mi", cnts + pcts,
                        month_index_of_str(F.lit(first_month)), month_index_of_str(F.lit(last_month)))
    w = Window.partitionBy(id_col).orderBy("_mi")
    cols = [F.coalesce(F.sum(c).over(w.rowsBetween(-n, -1)), F.lit(0)).alias(f"{c}_sum{n}") for c in cnts]
    cols += [trailing_mean_with_leading_zero(c, id_col, "_mi", n).alias(f"{c}_mean{n}") for c in pcts]
    return panel.select(id_col, month_from_index("_mi").alias("month"), *cols)


def class_breadth_monthly(events: DataFrame, classes, class_col: str = "product_group",
                          item_col: str = "product", id_col: str = "actor_id") -> DataFrame:
    """D48 step 1: distinct items per class per (id, month), wide with explicit classes.

    Nulls in class/item become 'UNKNOWN', unlisted classes 'OTHER'.  Two
    levels of aggregates give the pivot (no value-discovery job, no copies of
    the rows).
    """
    cls = listed_class(class_col, classes)
    item = F.coalesce(F.col(item_col), F.lit("UNKNOWN"))
    kinds = {f"n_{_safe(c)}": F.col("_cls") == c for c in classes}
    return distinct_by_kind(events.select(id_col, "month", cls.alias("_cls"), item.alias("_item")), [id_col, "month"], "_item", kinds)


def class_breadth_trailing(events: DataFrame, classes, first_month: str, last_month: str,
                           n: int = 12, **kw) -> DataFrame:
    """Dense over actors x months, trailing n-month sum of monthly breadth."""
    wide = class_breadth_monthly(events, classes, **kw).withColumn("_mi", month_index_of_str("month")).drop("month")
    cols = [f"n_{_safe(c)}" for c in classes]
    panel = dense_panel(wide, "actor_id", "_mi", cols,
                        month_index_of_str(F.lit(first_month)), month_index_of_str(F.lit(last_month)))
    w = Window.partitionBy("actor_id").orderBy("_mi").rowsBetween(-n, -1)
    return panel.select("actor_id", month_from_index("_mi").alias("month"),
                        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_sum{n}") for c in cols])


def _safe(v: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in str(v)).strip("_").upper()
