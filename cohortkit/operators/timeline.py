"""Subject and actor timelines.

Windows are partitioned by (actor, subject) or subject over *weekly
aggregates*, so a partition holds at most one row per (week, product, use):
bounded by the time axis, not by raw event counts.  Rankings of ids by
count rank the (small) set of distinct counts and join back instead of an
unpartitioned window over all ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.dates import week_start
from cohortkit.functions.exprs import recode_use
from cohortkit.operators.shape import col_name, long_to_wide


def weekly_quantity(events: DataFrame, keys=("subject_id",)) -> DataFrame:
    """Quantity per (keys, product, use, Monday week); null use -> '1'."""
    return (events.filter(F.col("product").isNotNull())
                  .withColumn("week", week_start("event_date"))
                  .groupBy(*keys, "product", F.coalesce(F.col("use_flag"), F.lit("1")).alias("use"), "week")
                  .agg(F.sum("quantity").alias("quantity")))


def market_overview(weekly: DataFrame, products) -> DataFrame:
    """Per month (of the week start) and product: distinct subjects and
    total quantity, wide by product with explicit product values."""
    m = weekly.select(F.date_format("week", "yyyy-MM").alias("month"), "product", "subject_id", "quantity")
    seen = m.groupBy("month", "product", "subject_id").agg(F.sum("quantity").alias("quantity"))
    # products are disjoint, so one row for each (month, product, subject) is all that is counted
    long = seen.groupBy("month", "product").agg(F.count("subject_id").alias("subjects"), F.sum("quantity").alias("quantity"))
    wide = long_to_wide(long, "month", "product", ["subjects", "quantity"], products, agg="sum")
    return wide.fillna(0, [col_name(p, "subjects") for p in products])


OTHER_LABEL = "QTY_OTHER"


def quantity_label(product, use) -> str:
    return f"QTY_{product}_USE_{use}"


def weekly_wide(weekly: DataFrame, labels) -> DataFrame:
    """Subject x week, one quantity column per label, 0-filled.

    Quantities whose label is not listed go to ``OTHER_LABEL``, so that the
    columns always add up to the subject's total.  The narrow rows are dealt
    by subject once; a week's few labels lie side by side as a map, and the
    wide row is made from it last, so no aggregate holds a buffer for each
    column and no wide row is shuffled.
    """
    k = F.concat(F.lit("QTY_"), F.col("product"), F.lit("_USE_"), F.col("use"))
    named = [v for v in labels if v != OTHER_LABEL]
    # the place of a label, 0 for the others
    place = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in named]).cast("array<string>"), k), F.lit(0)).cast("int")
    w = weekly.select("subject_id", "week", place.alias("_k"), "quantity").repartition("subject_id")
    per = w.groupBy("subject_id", "week", "_k").agg(F.sum("quantity").alias("_q"))
    wide = per.groupBy("subject_id", "week").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_q"))).alias("_by_label"))
    at = [*range(1, len(named) + 1), 0]
    return wide.select("subject_id", "week", *[F.coalesce(F.try_element_at("_by_label", F.lit(i)), F.lit(0.0)).alias(col_name(v))
                                               for i, v in zip(at, (*named, OTHER_LABEL))])


def active_weeks(weekly: DataFrame) -> DataFrame:
    """Distinct active weeks per subject."""
    return weekly.groupBy("subject_id").agg(F.countDistinct("week").alias("week_cnt"))


def column_stddevs(wide: DataFrame, id_col: str, cols, **more) -> DataFrame:
    """Sample stddev per id of each column, plus their row total (A23); ``more`` adds aggregates by name."""
    from cohortkit.functions.exprs import row_total

    s = wide.groupBy(id_col).agg(*[F.stddev_samp(c).alias(f"std_{c}") for c in cols], *[a.alias(n) for n, a in more.items()])
    return s.withColumn("row_total", row_total([f"std_{c}" for c in cols]))


def therapy_timeline(events: DataFrame, threshold: str) -> DataFrame:
    """Weekly rows per (actor, subject, product, use) with previous / first
    week, whole weeks since each (null -> 0) and the '||' marker on the first
    week on or after ``threshold``.  UNK use -> '0', null use -> '1'."""
    wk = weekly_quantity(events, ("actor_id", "subject_id")).withColumn(
        "use", recode_use("use", unknown_as="0", null_as="1"))
    wk = wk.withColumn("label", F.concat_ws("-", "product", "use"))
    pair = Window.partitionBy("actor_id", "subject_id")
    ordered = pair.orderBy("week", "label", "quantity")
    first_after = F.min(F.when(F.col("week") >= F.to_date(F.lit(threshold)), F.col("week"))).over(pair)
    out = (wk.withColumn("prev_week", F.lag("week").over(ordered))
             .withColumn("first_week", F.min("week").over(pair))
             .withColumn("weeks_since_prev", F.coalesce((F.datediff("week", "prev_week") / 7).cast("int"), F.lit(0)))
             .withColumn("weeks_since_first", F.coalesce((F.datediff("week", "first_week") / 7).cast("int"), F.lit(0)))
             .withColumn("marker", F.when(F.col("week") == first_after, F.lit("||")).otherwise(F.lit(""))))
    return out.select("actor_id", "subject_id", "product", "use", "label", "week", "quantity", "prev_week",
                      "first_week", "weeks_since_prev", "weeks_since_first", "marker")


def history_string(timeline: DataFrame) -> DataFrame:
    """Per (actor, subject) ordered history 'marker+label, ...',
    longest gap in weeks and total duration (weeks since first at the last week)."""
    item = F.struct("week", "label", F.concat("marker", "label").alias("s"))
    return (timeline.groupBy("actor_id", "subject_id")
                    .agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ", ")
                         .alias("history"),
                         F.max("weeks_since_prev").alias("max_gap_weeks"),
                         F.max_by("weeks_since_first", F.struct("week", "label")).alias("total_weeks")))


def first_subject(events: DataFrame, product: str, start: str, end: str) -> DataFrame:
    """Per actor, the subject of its first ``product`` event in [start, end]
    (earliest date, then lowest subject id)."""
    ev = events.filter((F.col("product") == product) & (F.col("event_date") >= F.to_date(F.lit(start)))
                       & (F.col("event_date") <= F.to_date(F.lit(end))))
    return ev.groupBy("actor_id").agg(
        F.min_by("subject_id", F.struct("event_date", "subject_id")).alias("subject_id"),
        F.min("event_date").alias("first_date"))


def rank_ids_by_count(counts: DataFrame, id_col: str, count_col: str, n: int) -> DataFrame:
    """Dense rank of ids by count (ties kept), rank <= n.

    The ranking window runs over the distinct count values only (at most
    one row per distinct count), then joins back to the ids.
    """
    ranks = (counts.select(count_col).distinct()
                   .withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc(count_col))))
                   .filter(F.col("rank") <= n))
    return counts.join(ranks, count_col).select(id_col, count_col, "rank")


def top_users_dense_rank(weekly: DataFrame, product: str, n: int) -> DataFrame:
    """Weekly rows of the subjects whose count of ``product`` weeks has dense rank <= n."""
    cnt = (weekly.filter((F.col("product") == product) & F.col("use").isNotNull())
                 .groupBy("subject_id").agg(F.count(F.lit(1)).alias("record_count")))
    top = rank_ids_by_count(cnt, "subject_id", "record_count", n)
    return weekly.join(top, "subject_id")


def top_users_with_other(weekly: DataFrame, product: str, others, n: int) -> DataFrame:
    """Top-n subjects (count desc, id asc) among those who also used one
    of ``others``; returns their counts (TakeOrderedAndProject, no global sort)."""
    other_ids = weekly.filter(F.col("product").isin(list(others))).select("subject_id").distinct()
    cnt = (weekly.filter((F.col("product") == product) & F.col("use").isNotNull())
                 .join(other_ids, "subject_id", "left_semi")
                 .groupBy("subject_id").agg(F.count(F.lit(1)).alias("record_count")))
    return cnt.orderBy(F.desc("record_count"), F.asc("subject_id")).limit(n)


def switchers(weekly: DataFrame, product: str, own_brands, year: int) -> DataFrame:
    """Subjects with a week of a non-own-brand product before their first
    ``product`` week; returns their ``product`` rows in ``year``."""
    first_t = weekly.groupBy("subject_id").agg(
        F.min(F.when(F.col("product") == product, F.col("week"))).alias("first_target_week"))
    elig = (weekly.join(first_t.filter(F.col("first_target_week").isNotNull()), "subject_id")
                  .filter((F.col("week") < F.col("first_target_week")) & ~F.col("product").isin(list(own_brands)))
                  .select("subject_id").distinct())
    return (weekly.join(elig, "subject_id", "left_semi")
                  .filter((F.col("product") == product) & (F.year("week") == year)))
