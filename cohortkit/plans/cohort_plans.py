"""Cohort queries: spine (flagship) and its variants, classes and counts."""

from __future__ import annotations

from cohortkit.config import TEST_CONFIG as C
from cohortkit.operators import cohort as co
from cohortkit.plans.oracle_sql import EV, with_
from cohortkit.plans.registry import register
from cohortkit.sources.roles import event_log

T = C.target_product


def classes_sql(require_inclusion=True, nonuser_lookback=None, row_level=False) -> str:
    """DuckDB CTEs computing actor classes (s, anchors, cls)."""
    n_user = C.lookback_months
    n_non = C.lookback_months if nonuser_lookback is None else nonuser_lookback
    incl = "prior_active = 1 AND study_active = 1" if require_inclusion else "study_active = 1"
    non = "study_other = 1" if row_level else "study_user = 0"
    return f"""
s AS (
  SELECT actor_id,
         max(CASE WHEN month < '{C.study_start}' THEN 1 ELSE 0 END) AS prior_active,
         max(CASE WHEN month >= '{C.study_start}' THEN 1 ELSE 0 END) AS study_active,
         max(CASE WHEN month >= '{C.study_start}' AND product = '{T}' THEN 1 ELSE 0 END) AS study_user,
         max(CASE WHEN month >= '{C.study_start}' AND product IS DISTINCT FROM '{T}' THEN 1 ELSE 0 END) AS study_other,
         min(CASE WHEN month >= '{C.study_start}' AND product = '{T}' THEN event_date END) AS first_t,
         min(CASE WHEN month >= '{C.study_start}' THEN event_date END) AS first_any
  FROM ev WHERE month >= '{C.first_month}' AND month <= '{C.study_end}'
  GROUP BY actor_id
),
anchors AS (
  SELECT actor_id, 'user' AS branch, first_t AS anchor_date, {n_user} AS n FROM s
  WHERE {incl} AND study_user = 1
  UNION ALL
  SELECT actor_id, 'non_user' AS branch, first_any AS anchor_date, {n_non} AS n FROM s
  WHERE {incl} AND {non}
),
a2 AS (
  SELECT *, year(anchor_date) * 12 + month(anchor_date) - 1 AS ai,
         year(anchor_date) * 12 + month(anchor_date) - 1 - n - 1 AS lbi
  FROM anchors
),
cnt AS (
  SELECT a2.actor_id, a2.branch, a2.anchor_date, a2.ai, a2.lbi,
         count(CASE WHEN ev.product = '{T}' THEN 1 END) AS target_rows,
         count(DISTINCT CASE WHEN ev.product = '{T}' THEN ev.subject_id END) AS target_subjects,
         count(CASE WHEN ev.actor_id IS NOT NULL AND ev.product IS DISTINCT FROM '{T}' THEN 1 END) AS other_rows,
         count(DISTINCT CASE WHEN ev.product IS DISTINCT FROM '{T}' THEN ev.subject_id END) AS other_subjects
  FROM a2 LEFT JOIN ev ON ev.actor_id = a2.actor_id AND ev.mi >= a2.lbi AND ev.mi < a2.ai
  GROUP BY 1, 2, 3, 4, 5
),
cls AS (
  SELECT actor_id, branch, anchor_date, strftime(anchor_date, '%Y-%m') AS anchor_month,
         printf('%04d-%02d', CAST(floor(lbi / 12) AS INTEGER), CAST(lbi % 12 + 1 AS INTEGER)) AS lookback_start_month,
         target_rows, target_subjects, other_rows, other_subjects,
         CASE WHEN branch = 'user' THEN CASE WHEN target_rows = 0 THEN 'new' ELSE 'existing' END
              ELSE CASE WHEN target_rows = 0 THEN 'never' ELSE 'discontinued' END END AS actor_class
  FROM cnt
)"""


def spine_cte(**kw) -> str:
    """CTEs (s .. cls, spine) for the default spine, to embed in larger oracle queries."""
    return classes_sql(**kw) + f""",
spine AS (
  SELECT actor_id, anchor_month AS cohort_month, 1 AS target FROM cls WHERE actor_class = 'new'
  UNION ALL
  SELECT DISTINCT ev.actor_id, ev.month AS cohort_month, 0 AS target FROM ev
  WHERE ev.month >= '{C.study_start}' AND ev.month <= '{C.study_end}'
    AND ev.actor_id IN (SELECT actor_id FROM cls WHERE actor_class = 'never')
)"""


def spine_sql(never_months="active", **kw) -> str:
    if never_months == "first":
        nev = "SELECT actor_id, anchor_month AS cohort_month FROM cls WHERE actor_class = 'never'"
    elif never_months == "all":
        nev = f"""SELECT c.actor_id, strftime(m.d, '%Y-%m') AS cohort_month
          FROM cls c, (SELECT unnest(generate_series(DATE '{C.study_start}-01', DATE '{C.study_end}-01',
                       INTERVAL 1 MONTH)) AS d) m
          WHERE c.actor_class = 'never'"""
    else:
        nev = f"""SELECT DISTINCT ev.actor_id, ev.month AS cohort_month FROM ev
          WHERE ev.month >= '{C.study_start}' AND ev.month <= '{C.study_end}'
            AND ev.actor_id IN (SELECT actor_id FROM cls WHERE actor_class = 'never')"""
    return with_(EV, classes_sql(**kw)) + f"""
SELECT actor_id, anchor_month AS cohort_month, CAST(1 AS BIGINT) AS target FROM cls WHERE actor_class = 'new'
UNION ALL
SELECT actor_id, cohort_month, CAST(0 AS BIGINT) AS target FROM ({nev}) x"""


def _ev(spark, sf):
    return event_log(spark, sf)


def _spine_window():
    """Dates the spine needs: the prior period start (or the earliest
    look-back start, if earlier) through the last study day."""
    lo = min(C.first_month, _shift(C.study_start, -(max(C.lookback_months, 36) + 1)))
    return f"{lo}-01", C.study_end_date


def _shift(month: str, n: int) -> str:
    y, m = (int(x) for x in month.split("-"))
    i = y * 12 + m - 1 + n
    return f"{i // 12:04d}-{i % 12 + 1:02d}"


def _ev_spine(spark, sf):
    return event_log(spark, sf, *_spine_window())


def _ev_study(spark, sf):
    return event_log(spark, sf, C.study_start_date, C.study_end_date)


@register("target_spine", spine_sql())
def q_target_spine(spark, sf):
    """D20 flagship: new users at their first month (1), never users per active study month (0)."""
    return co.target_spine(_ev_spine(spark, sf), C)


@register("target_spine_all_months", spine_sql("all"))
def q_target_spine_all_months(spark, sf):
    """Never users get every study month."""
    return co.target_spine(_ev_spine(spark, sf), C, never_months="all")


@register("target_spine_no_inclusion", spine_sql("first", require_inclusion=False))
def q_target_spine_no_inclusion(spark, sf):
    """No prior-activity rule; never users at their first study month only."""
    return co.target_spine(_ev_spine(spark, sf), C, never_months="first", require_inclusion=False)


@register("target_spine_nonuser_36", spine_sql(nonuser_lookback=36))
def q_target_spine_nonuser_36(spark, sf):
    """36-month look-back for non-users."""
    return co.target_spine(_ev_spine(spark, sf), C, nonuser_lookback_months=36)


@register("target_spine_row_level", spine_sql(row_level=True))
def q_target_spine_row_level(spark, sf):
    """D20d: non-users = actors with any non-target study row (sets may overlap)."""
    return co.target_spine(_ev_spine(spark, sf), C, row_level_nonusers=True)


@register("actor_classes", with_(EV, classes_sql()) + """
SELECT actor_id, branch, strftime(anchor_date, '%Y-%m-%d') AS anchor_date, anchor_month,
       lookback_start_month, target_rows, target_subjects, other_rows, other_subjects, actor_class
FROM cls""")
def q_actor_classes(spark, sf):
    """New / existing / discontinued / never with look-back counts."""
    return co.actor_classes(_ev_spine(spark, sf), C)


@register("period_activity", with_(EV) + f"""
SELECT actor_id, count(DISTINCT subject_id) AS n_subjects FROM ev
WHERE month >= '{C.study_start}' AND month <= '{C.study_end}' GROUP BY actor_id""")
def q_period_activity(spark, sf):
    """Distinct subjects per actor in the study months."""
    return co.period_activity(_ev_study(spark, sf), C.study_start, C.study_end)


@register("inclusion_set", with_(EV) + f"""
SELECT actor_id FROM ev WHERE month >= '{C.first_month}' AND month < '{C.study_start}'
INTERSECT
SELECT actor_id FROM ev WHERE month >= '{C.study_start}' AND month <= '{C.study_end}'""")
def q_inclusion_set(spark, sf):
    """Active before and during the study."""
    return co.inclusion_set(event_log(spark, sf, f"{C.first_month}-01", C.study_end_date), C)


@register("product_user_flag", with_(EV) + f"""
SELECT actor_id, CAST(max(CASE WHEN product = '{T}' THEN 1 ELSE 0 END) AS BIGINT) AS user_flag FROM ev
WHERE month >= '{C.study_start}' AND month <= '{C.study_end}' GROUP BY actor_id""")
def q_product_user_flag(spark, sf):
    """Target users among study-active actors."""
    return co.product_user_flag(_ev_study(spark, sf), T, C.study_start, C.study_end)


FIRST_SQL = f"""
f AS (
  SELECT actor_id, min(event_date) AS first_date FROM ev
  WHERE product = '{T}' AND event_date >= DATE '{C.study_start_date}' AND event_date <= DATE '{C.study_end_date}'
  GROUP BY actor_id
),
f2 AS (
  SELECT actor_id, first_date, strftime(first_date, '%Y-%m') AS first_month,
         CAST(first_date - INTERVAL {C.lookback_months + 1} MONTH AS DATE) AS lookback_start_date
  FROM f
)"""


@register("first_event", with_(EV, FIRST_SQL) + """
SELECT actor_id, strftime(first_date, '%Y-%m-%d') AS first_date, first_month,
       strftime(lookback_start_date, '%Y-%m-%d') AS lookback_start_date,
       strftime(lookback_start_date, '%Y-%m') AS lookback_start_month
FROM f2""")
def q_first_event(spark, sf):
    """First target event in the study with its look-back start."""
    return co.first_event(_ev_study(spark, sf), C.study_start_date, C.study_end_date, C.lookback_months, T)


@register("lookback_counts", with_(EV, FIRST_SQL) + f"""
SELECT f2.actor_id,
       count(CASE WHEN ev.product = '{T}' THEN 1 END) AS target_rows,
       count(DISTINCT CASE WHEN ev.product = '{T}' THEN ev.subject_id END) AS target_subjects,
       count(CASE WHEN ev.actor_id IS NOT NULL AND ev.product IS DISTINCT FROM '{T}' THEN 1 END) AS other_rows,
       count(DISTINCT CASE WHEN ev.product IS DISTINCT FROM '{T}' THEN ev.subject_id END) AS other_subjects
FROM f2 LEFT JOIN ev ON ev.actor_id = f2.actor_id
  AND ev.month >= strftime(f2.lookback_start_date, '%Y-%m') AND ev.month < f2.first_month
GROUP BY f2.actor_id""")
def q_lookback_counts(spark, sf):
    """Target / other rows and subjects in the look-back before the first target event."""
    ev = _ev(spark, sf)
    firsts = co.first_event(ev, C.study_start_date, C.study_end_date, C.lookback_months, T)
    return co.lookback_counts(ev, firsts, T)


@register("spine_monthly_counts", spine_sql().replace(
    "SELECT actor_id, anchor_month AS cohort_month, CAST(1 AS BIGINT)",
    "SELECT cohort_month, CAST(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new_count, "
    "CAST(sum(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS never_count FROM (\n"
    "SELECT actor_id, anchor_month AS cohort_month, CAST(1 AS BIGINT)", 1) + ") sp GROUP BY cohort_month")
def q_spine_monthly_counts(spark, sf):
    """Spine rows per cohort month and label."""
    return co.spine_monthly_counts(co.target_spine(_ev_spine(spark, sf), C))


@register("spine_disjoint_check", spine_sql().replace(
    "SELECT actor_id, anchor_month AS cohort_month, CAST(1 AS BIGINT)",
    "SELECT actor_id, count(DISTINCT target) AS n_labels FROM (\n"
    "SELECT actor_id, anchor_month AS cohort_month, CAST(1 AS BIGINT)", 1)
    + ") sp GROUP BY actor_id HAVING count(DISTINCT target) > 1")
def q_spine_disjoint_check(spark, sf):
    """Actors carrying both labels (expected empty)."""
    return co.spine_disjoint_check(co.target_spine(_ev_spine(spark, sf), C))


@register("spine_disjoint_check_row_level", spine_sql(row_level=True).replace(
    "SELECT actor_id, anchor_month AS cohort_month, CAST(1 AS BIGINT)",
    "SELECT actor_id, count(DISTINCT target) AS n_labels FROM (\n"
    "SELECT actor_id, anchor_month AS cohort_month, CAST(1 AS BIGINT)", 1)
    + ") sp GROUP BY actor_id HAVING count(DISTINCT target) > 1")
def q_spine_disjoint_check_row_level(spark, sf):
    """U5 on the row-level variant, where the two sets can overlap."""
    return co.spine_disjoint_check(co.target_spine(_ev_spine(spark, sf), C, row_level_nonusers=True))


@register("new_user_volume", with_(EV, classes_sql()) + f"""
SELECT ev.actor_id, count(*) AS n_records, count(DISTINCT ev.subject_id) AS n_subjects
FROM ev WHERE ev.product = '{T}' AND ev.actor_id IN (SELECT actor_id FROM cls WHERE actor_class = 'new')
GROUP BY ev.actor_id""")
def q_new_user_volume(spark, sf):
    """All-time target rows and subjects of each new user."""
    ev = _ev(spark, sf)
    return co.new_user_volume(ev, co.actor_classes(ev, C), T)


NTP_SQL = f"""
pr AS (SELECT subject_id AS id, event_date AS d FROM ev WHERE product = '{T}'),
idx AS (SELECT id, min(d) AS index_date FROM pr WHERE d >= DATE '{C.study_start_date}' GROUP BY id),
prior AS (
  SELECT DISTINCT idx.id FROM idx JOIN pr ON pr.id = idx.id
  WHERE pr.d >= CAST(idx.index_date - INTERVAL 2 YEAR AS DATE) AND pr.d < idx.index_date
),
ntp AS (
  SELECT idx.id AS subject_id, idx.index_date, strftime(idx.index_date, '%Y-%m') AS index_month,
         CASE WHEN prior.id IS NULL THEN 'new' ELSE 'existing' END AS status
  FROM idx LEFT JOIN prior ON idx.id = prior.id
)"""


@register("new_to_product_ids", with_(EV, NTP_SQL) + """
SELECT subject_id, strftime(index_date, '%Y-%m-%d') AS index_date, index_month, status FROM ntp""")
def q_new_to_product_ids(spark, sf):
    """Subjects new to the target (no use in the 2 years before their index date)."""
    return co.new_to_product(_ev(spark, sf), T, C.study_start_date, 2)


@register("new_to_product_monthly", with_(EV, NTP_SQL) + """
SELECT index_month,
       CAST(sum(CASE WHEN status = 'new' THEN 1 ELSE 0 END) AS BIGINT) AS new_count,
       CAST(sum(CASE WHEN status = 'existing' THEN 1 ELSE 0 END) AS BIGINT) AS existing_count,
       CAST(count(*) AS BIGINT) AS total_count
FROM ntp GROUP BY index_month""")
def q_new_to_product_monthly(spark, sf):
    """D9 report: new / existing / total per index month."""
    return co.new_to_product_monthly(co.new_to_product(_ev(spark, sf), T, C.study_start_date, 2))


@register("new_to_product_actor_ids", with_(EV, NTP_SQL.replace("subject_id AS id", "actor_id AS id")
                                           .replace("idx.id AS subject_id", "idx.id AS actor_id")) + """
SELECT actor_id, strftime(index_date, '%Y-%m-%d') AS index_date, index_month, status FROM ntp""")
def q_new_to_product_actor_ids(spark, sf):
    """D9 on the actor id (the reference runs it for both ids)."""
    return co.new_to_product(_ev(spark, sf), T, C.study_start_date, 2, id_col="actor_id")


@register("target_spine_sorted", spine_sql())
def q_target_spine_sorted(spark, sf):
    """The spine in the reference's output order (target desc, actor, month);
    the only global sort, applied at output."""
    return co.sort_spine(co.target_spine(_ev_spine(spark, sf), C))


@register("study_window_scan", with_(EV) + f"""
SELECT actor_id, subject_id, strftime(event_date, '%Y-%m-%d') AS event_date, product, quantity FROM ev
WHERE event_date BETWEEN DATE '{C.study_start_date}' AND DATE '{C.study_end_date}'""")
def q_study_window_scan(spark, sf):
    """Inclusive date-window scan (both ends kept), pushed into the
    lineitem parquet reader, with a column shortlist."""
    return _ev_study(spark, sf).select("actor_id", "subject_id", "event_date", "product", "quantity")
