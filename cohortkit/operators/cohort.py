"""Cohort labelling: activity, inclusion, first events, look-back counts,
actor classes and the target spine (D9, D14-D22).

Plan shape of the spine: one aggregate per actor over the study range gives
inclusion, user flag, anchor date and the months of target events (as bits) in
a single pass, which is all the spine needs; for the classes with their counts
one join of the event log to those per-actor anchors plus a conditional
aggregate gives the look-back counts.  No key list ever reaches the driver; set membership is a
semi/anti join.  Per-actor skew is harmless: every aggregate is partial
(map-side) before the shuffle, and the join's other side has one row per
actor (AQE splits skewed partitions of the large side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.config import StudyConfig
from cohortkit.functions.dates import month_from_index, month_index, month_index_of_str, month_str
from cohortkit.operators.distinct import distinct_by_kind


def _is(product: str):
    return F.col("product").eqNullSafe(F.lit(product))


def period_activity(events: DataFrame, start_month: str, end_month: str,
                    end_inclusive: bool = True) -> DataFrame:
    """Distinct subjects per actor with a row in the month window."""
    hi = F.col("month") <= end_month if end_inclusive else F.col("month") < end_month
    return (events.filter((F.col("month") >= start_month) & hi)
                  .groupBy("actor_id")
                  .agg(F.countDistinct("subject_id").alias("n_subjects")))


def inclusion_set(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Actors active in [first_month, study_start) and in [study_start, study_end].

    One aggregate instead of two aggregates and an intersect.
    """
    m = F.col("month")
    return (events.filter((m >= cfg.first_month) & (m <= cfg.study_end))
                  .groupBy("actor_id")
                  .agg(F.max((m < cfg.study_start).cast("int")).alias("_p"),
                       F.max((m >= cfg.study_start).cast("int")).alias("_s"))
                  .filter((F.col("_p") == 1) & (F.col("_s") == 1))
                  .select("actor_id"))


def product_user_flag(events: DataFrame, product: str, start_month: str, end_month: str) -> DataFrame:
    """Every actor with a row in the window, flag 1 if any row is of ``product``."""
    m = F.col("month")
    return (events.filter((m >= start_month) & (m <= end_month))
                  .groupBy("actor_id")
                  .agg(F.max(_is(product).cast("int")).alias("user_flag")))


def first_event(events: DataFrame, start_date: str, end_date: str, lookback_months: int,
                product: str | None = None) -> DataFrame:
    """First event per actor in [start_date, end_date] (of ``product`` if given).

    Adds its month, and the look-back start = first - (lookback_months + 1)
    months (calendar clamped, like a month offset) and that month.
    """
    d = F.col("event_date")
    cond = (d >= F.to_date(F.lit(start_date))) & (d <= F.to_date(F.lit(end_date)))
    if product is not None:
        cond = cond & _is(product)
    firsts = events.filter(cond).groupBy("actor_id").agg(F.min("event_date").alias("first_date"))
    lb = F.add_months("first_date", -(lookback_months + 1))
    return firsts.select(
        "actor_id", "first_date", month_str("first_date").alias("first_month"),
        lb.alias("lookback_start_date"), month_str(lb).alias("lookback_start_month"))


def _window_counts(rows: DataFrame, keys, is_target) -> DataFrame:
    """Rows and distinct subjects of the target product and of all others, per ``keys``."""
    return distinct_by_kind(rows, keys, "subject_id", {"target_subjects": is_target, "other_subjects": ~is_target},
                            {"target_rows": (F.sum, is_target.cast("long")), "other_rows": (F.sum, (~is_target).cast("long"))})


def lookback_counts(events: DataFrame, firsts: DataFrame, product: str,
                    anchor_month_col: str = "first_month",
                    start_month_col: str = "lookback_start_month") -> DataFrame:
    """Rows and distinct subjects of ``product`` / other in [start, anchor).

    A null product counts as "other" (``NOT (product <=> t)``).  Every actor
    of ``firsts`` is returned; actors with nothing in the window get zeros.
    """
    f = firsts.select("actor_id", F.col(anchor_month_col).alias("_a"),
                      F.col(start_month_col).alias("_lb"))
    ev = events.select("actor_id", "subject_id", "product", "month")
    inwin = (F.col("month") >= F.col("_lb")) & (F.col("month") < F.col("_a"))
    t = _is(product)
    counts = _window_counts(ev.join(f, "actor_id").filter(inwin), ["actor_id"], t)
    out = f.select("actor_id").join(counts, "actor_id", "left")
    return out.fillna(0, ["target_rows", "target_subjects", "other_rows", "other_subjects"])


#: Months in one long bit set.
MONTH_BITS = 62


def _month_words(index, condition, lo: int, hi: int, name: str) -> list:
    """Aggregates, one long for each 62 months of lo..hi: the months in which ``condition`` holds for a row, as bits."""
    words = []
    for k, first in enumerate(range(lo, hi + 1, MONTH_BITS)):
        here = condition & index.between(first, min(first + MONTH_BITS - 1, hi))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), index - F.lit(first))
        words.append(F.bit_or(F.when(here, bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}_{k}"))
    return words


def _months_of(name: str, lo: int, hi: int):
    """The month indexes, ascending, of the bits that ``_month_words`` set."""
    words = F.array(*[F.col(f"{name}_{k}") for k in range(len(range(lo, hi + 1, MONTH_BITS)))])
    at = lambda i: (i - F.lit(lo)).cast("int")
    return F.filter(F.sequence(F.lit(lo), F.lit(hi)),
                    lambda i: F.getbit(F.get(words, F.floor(at(i) / MONTH_BITS).cast("int")), at(i) % MONTH_BITS) == 1)


def _index_of(month: str) -> int:
    return int(month[:4]) * 12 + int(month[5:7]) - 1


def study_summary(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Per actor, one pass: prior/study activity, user flags, anchor dates and
    the sorted set of active study months (bounded by the study calendar)."""
    m = F.col("month")
    t = _is(cfg.target_product)
    in_study = (m >= cfg.study_start) & (m <= cfg.study_end)
    return (events.filter((m >= cfg.first_month) & (m <= cfg.study_end))
                  .groupBy("actor_id")
                  .agg(F.max((m < cfg.study_start).cast("int")).alias("prior_active"),
                       F.max(in_study.cast("int")).alias("study_active"),
                       F.max((in_study & t).cast("int")).alias("study_user"),
                       F.max((in_study & ~t).cast("int")).alias("study_other"),
                       F.min(F.when(in_study & t, F.col("event_date"))).alias("first_target_date"),
                       F.min(F.when(in_study, F.col("event_date"))).alias("first_any_date"),
                       F.array_sort(F.collect_set(F.when(in_study, m))).alias("study_months")))


def _anchors(summary: DataFrame, cfg: StudyConfig, require_inclusion: bool, nonuser_lookback_months: int | None,
             row_level_nonusers: bool, keep) -> DataFrame:
    """The branches (user, non_user) of each included actor, their anchor dates and look-back ranges."""
    n_user = cfg.lookback_months
    n_non = cfg.lookback_months if nonuser_lookback_months is None else nonuser_lookback_months
    incl = (F.col("prior_active") == 1) & (F.col("study_active") == 1) if require_inclusion \
        else (F.col("study_active") == 1)
    non_cond = (F.col("study_other") == 1) if row_level_nonusers else (F.col("study_user") == 0)
    branch = F.struct
    choices = F.array(
        F.when(incl & (F.col("study_user") == 1),
               branch(F.lit("user").alias("branch"), F.col("first_target_date").alias("anchor_date"),
                      F.lit(n_user).alias("n"))),
        F.when(incl & non_cond,
               branch(F.lit("non_user").alias("branch"), F.col("first_any_date").alias("anchor_date"),
                      F.lit(n_non).alias("n"))))
    return (summary.select("actor_id", *keep,
                           F.explode(F.filter(choices, lambda x: x.isNotNull())).alias("b"))
                   .select("actor_id", *keep, "b.branch", "b.anchor_date",
                           month_index(F.col("b.anchor_date")).alias("_ai"),
                           (month_index(F.col("b.anchor_date")) - F.col("b.n") - 1).alias("_lbi")))


def _class_of(has_target):
    """An anchor's class, given whether a target event falls in its look-back range."""
    return (F.when(F.col("branch") == "user", F.when(~has_target, "new").otherwise("existing"))
             .otherwise(F.when(~has_target, "never").otherwise("discontinued")))


def study_classes(events: DataFrame, cfg: StudyConfig, require_inclusion: bool = True,
                  nonuser_lookback_months: int | None = None, row_level_nonusers: bool = False) -> DataFrame:
    """D19 without the look-back counts: (actor_id, anchor_month, actor_class, study_months).

    One aggregate per actor: the months with target events, bounded by the
    calendar, travel as bits, so the look-back is judged without a second pass
    over the events.  All buffers are of fixed width.
    """
    m, t = F.col("month"), _is(cfg.target_product)
    longest = max(cfg.lookback_months, nonuser_lookback_months or 0)
    lo, hi = _index_of(cfg.study_start), _index_of(cfg.study_end)
    first = lo - longest - 1
    in_range = (m >= cfg.first_month) & (m <= cfg.study_end)
    in_study = (m >= cfg.study_start) & (m <= cfg.study_end)
    mi = month_index("event_date")
    before = t & mi.between(first, hi)
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    summary = (events.filter(in_range | before).groupBy("actor_id").agg(
        flag(in_range & (m < cfg.study_start)).alias("prior_active"), flag(in_study).alias("study_active"),
        flag(in_study & t).alias("study_user"), flag(in_study & ~t).alias("study_other"),
        F.min(F.when(in_study & t, F.col("event_date"))).alias("first_target_date"),
        F.min(F.when(in_study, F.col("event_date"))).alias("first_any_date"),
        *_month_words(month_index_of_str("month"), in_study, lo, hi, "_study"), *_month_words(mi, before, first, hi, "_target"))
        .select("*", F.transform(_months_of("_study", lo, hi), lambda i: month_from_index(i)).alias("study_months"),
                _months_of("_target", first, hi).alias("_target_months")))
    anchors = _anchors(summary, cfg, require_inclusion, nonuser_lookback_months, row_level_nonusers, ["study_months", "_target_months"])
    # events without an actor belong to no anchor
    has_target = F.col("actor_id").isNotNull() & F.exists("_target_months", lambda i: (i >= F.col("_lbi")) & (i < F.col("_ai")))
    return anchors.select("actor_id", month_str("anchor_date").alias("anchor_month"), _class_of(has_target).alias("actor_class"), "study_months")


def actor_classes(events: DataFrame, cfg: StudyConfig, require_inclusion: bool = True,
                  nonuser_lookback_months: int | None = None,
                  row_level_nonusers: bool = False, keep_months: bool = False) -> DataFrame:
    """Label included actors new / existing (users) or discontinued / never (non-users).

    users      = an event of the target product in the study months, anchored
                 at their first target event;
    non-users  = the other included actors (or, ``row_level_nonusers``, every
                 actor with a non-target study event, so the sets may overlap),
                 anchored at their first study event of any product.
    A user is *new* and a non-user *never* when no target event falls in
    [anchor - (N+1) months, anchor month).

    Two passes over the events: the per-actor summary, and one join of the
    events to the per-actor anchors (an inner join, so AQE can split a hot
    actor's events; actors with nothing in the window come back through a
    left join of the anchors, which reuses the anchors' shuffle).
    """
    anchors = _anchors(study_summary(events, cfg), cfg, require_inclusion, nonuser_lookback_months, row_level_nonusers, ["study_months"])
    t = _is(cfg.target_product)
    ev = events.select("actor_id", "subject_id", "product", month_index("event_date").alias("_mi"))
    inwin = (F.col("_mi") >= F.col("_lbi")) & (F.col("_mi") < F.col("_ai"))
    counts = _window_counts(ev.join(anchors.select("actor_id", "branch", "_ai", "_lbi"), "actor_id").filter(inwin),
                            ["actor_id", "branch"], t)
    out = (anchors.join(counts, ["actor_id", "branch"], "left")
                  .fillna(0, ["target_rows", "target_subjects", "other_rows", "other_subjects"]))
    cls = _class_of(F.col("target_rows") > 0)
    cols = ["actor_id", "branch", "anchor_date", month_str("anchor_date").alias("anchor_month"),
            month_from_index(F.col("_lbi")).alias("lookback_start_month"),
            "target_rows", "target_subjects", "other_rows", "other_subjects", cls.alias("actor_class")]
    return out.select(*cols, *(["study_months"] if keep_months else []))


def target_spine(events: DataFrame, cfg: StudyConfig, never_months: str = "active",
                 require_inclusion: bool = True, nonuser_lookback_months: int | None = None,
                 row_level_nonusers: bool = False, classes: DataFrame | None = None) -> DataFrame:
    """(actor_id, cohort_month, target) with a unique (actor, month) key per class.

    new   -> one row at the first target month, target 1;
    never -> ``never_months='active'``: one row per study month with an event;
             ``'all'``: every study month (D20a); ``'first'``: the anchor month (D20b).

    Rows come from one ``explode`` over the classes (the active months travel
    with each actor from the summary pass), so the events are read once in
    total and nothing is unioned or re-joined.
    """
    c = classes if classes is not None else study_classes(
        events, cfg, require_inclusion, nonuser_lookback_months, row_level_nonusers)
    if never_months == "first":
        nev = F.array(F.col("anchor_month"))
    elif never_months == "all":
        lo, hi = month_index_of_str(F.lit(cfg.study_start)), month_index_of_str(F.lit(cfg.study_end))
        nev = F.transform(F.sequence(lo, hi), lambda i: month_from_index(i))
    else:
        nev = F.col("study_months")
    months = (F.when(F.col("actor_class") == "new", F.array(F.col("anchor_month")))
               .when(F.col("actor_class") == "never", nev))
    return (c.filter(F.col("actor_class").isin("new", "never"))
             .select("actor_id", F.explode(months).alias("cohort_month"),
                     F.when(F.col("actor_class") == "new", 1).otherwise(0).alias("target")))


def sort_spine(spine: DataFrame) -> DataFrame:
    """Output order of the reference: target desc, actor, month."""
    return spine.orderBy(F.desc("target"), "actor_id", "cohort_month")


def spine_monthly_counts(spine: DataFrame) -> DataFrame:
    """Per cohort month, counts of new (1) and never (0) rows, 0-filled."""
    return (spine.groupBy("cohort_month")
                 .agg(F.sum((F.col("target") == 1).cast("long")).alias("new_count"),
                      F.sum((F.col("target") == 0).cast("long")).alias("never_count")))


def spine_disjoint_check(spine: DataFrame) -> DataFrame:
    """Actors that appear with both labels (empty when the classes are disjoint)."""
    return (spine.groupBy("actor_id")
                 .agg(F.countDistinct("target").alias("n_labels"))
                 .filter(F.col("n_labels") > 1))


def new_user_volume(events: DataFrame, classes: DataFrame, product: str) -> DataFrame:
    """Per new actor, all-time rows and distinct subjects of ``product``."""
    new = classes.filter(F.col("actor_class") == "new").select("actor_id")
    return (events.filter(_is(product))
                  .join(new, "actor_id", "left_semi")
                  .groupBy("actor_id")
                  .agg(F.count(F.lit(1)).alias("n_records"),
                       F.countDistinct("subject_id").alias("n_subjects")))


def new_to_product(events: DataFrame, product: str, start_date: str, lookback_years: int,
                   id_col: str = "subject_id", product_col: str = "product",
                   date_col: str = "event_date") -> DataFrame:
    """Per id, index = first ``product`` event on/after ``start_date``;
    existing when another ``product`` event lies in [index - N years, index), else new.

    Range join written as: per-id index (aggregate) -> equi-join on id ->
    range predicate -> conditional aggregate.  Only rows of the product are read.
    """
    pr = events.filter(F.col(product_col).eqNullSafe(F.lit(product))) \
               .select(F.col(id_col).alias("id"), F.col(date_col).alias("d"))
    idx = (pr.filter(F.col("d") >= F.to_date(F.lit(start_date)))
             .groupBy("id").agg(F.min("d").alias("index_date")))
    lb = F.add_months("index_date", -12 * lookback_years)
    prior = (pr.join(idx, "id")
               .filter((F.col("d") >= lb) & (F.col("d") < F.col("index_date")))
               .select("id").distinct().withColumn("_prior", F.lit(1)))
    return (idx.join(prior, "id", "left")
               .select(F.col("id").alias(id_col), "index_date",
                       month_str("index_date").alias("index_month"),
                       F.when(F.col("_prior").isNull(), "new").otherwise("existing").alias("status")))


def new_to_product_monthly(ntp: DataFrame) -> DataFrame:
    """D9 report: per index month, new, existing and total (missing as 0)."""
    return (ntp.groupBy("index_month")
               .agg(F.sum((F.col("status") == "new").cast("long")).alias("new_count"),
                    F.sum((F.col("status") == "existing").cast("long")).alias("existing_count"))
               .withColumn("total_count", F.col("new_count") + F.col("existing_count")))
