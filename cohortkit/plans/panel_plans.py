"""Panel, trailing-window and recency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.config import TEST_CONFIG as C
from cohortkit.functions.dates import month_before, week_start
from cohortkit.operators import panel as pn
from cohortkit.plans.oracle_sql import ACT, CLASS_SQL, CLASSES, EV, with_
from cohortkit.plans.registry import register
from cohortkit.sources.roles import activity_log, event_log

T = C.target_product
FLAGS_SQL = {"use": "use_flag = '1'", "open": "source = 'O'"}


def _mi(m: str) -> int:
    y, mm = m.split("-")
    return int(y) * 12 + int(mm) - 1


def _mstr(col: str) -> str:
    return f"printf('%04d-%02d', CAST(floor({col} / 12) AS INTEGER), CAST({col} % 12 + 1 AS INTEGER))"


def _flags():
    return {"use": F.col("use_flag") == "1", "open": F.col("source") == "O"}


@register("activity_counts", with_(ACT) + """
SELECT actor_id, strftime(event_date, '%Y-%m-%d') AS event_date, count(*) AS n_activities
FROM act GROUP BY actor_id, event_date""")
def q_activity_counts(spark, sf):
    """A1: activities per actor and day."""
    return activity_log(spark, sf).groupBy("actor_id", "event_date").agg(
        F.count(F.lit(1)).alias("n_activities"))


def _dense_sql(period: str, step: str) -> str:
    """Counts on the axis from the first to the last period of the data itself."""
    return f"""
acp AS (SELECT actor_id, CAST(date_trunc('{period}', event_date) AS DATE) AS period, count(*) AS n_activities FROM act GROUP BY 1, 2),
grid AS (
  SELECT a.actor_id, CAST(d.d AS DATE) AS period
  FROM (SELECT DISTINCT actor_id FROM act) a,
       (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 {step})) AS d FROM acp) d
),
dense AS (
  SELECT g.actor_id, strftime(g.period, '{"%Y-%m" if period == "month" else "%Y-%m-%d"}') AS period,
         coalesce(c.n_activities, 0) AS n_activities
  FROM grid g LEFT JOIN acp c ON g.actor_id = c.actor_id AND g.period = c.period
)"""


def _dense(spark, sf, period: str, ids=None):
    """Activities per actor and period, dense from the first to the last period of the log; of ``ids`` only, where given."""
    act = activity_log(spark, sf)
    days = act.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
    lo, hi = days.select("lo").scalar(), days.select("hi").scalar()
    if period == "month":
        lo, hi = F.trunc(lo, "month"), F.trunc(hi, "month")
    if ids is not None:
        act = act.join(ids, "actor_id", "left_semi")
    cnt = (act.groupBy("actor_id", F.trunc("event_date", "month").alias("period") if period == "month"
                       else F.col("event_date").alias("period"))
           .agg(F.count(F.lit(1)).alias("n_activities")))
    panel = pn.dense_panel(cnt, "actor_id", "period", "n_activities", lo, hi, f"interval 1 {period}",
                           ids=act.select("actor_id").distinct())
    return panel.withColumn("period", F.date_format("period", "yyyy-MM" if period == "month" else "yyyy-MM-dd"))


_TR = ",\n       ".join(
    f"CAST(coalesce(sum(n_activities) OVER (PARTITION BY actor_id ORDER BY period "
    f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev_{k:02d}_n_activities"
    for k in C.trailing_sizes)


@register("dense_panel", with_(ACT, _dense_sql("month", "MONTH")) + """
SELECT actor_id, period, n_activities FROM dense""")
def q_dense_panel(spark, sf):
    """Every actor x every month from the log's first to its last, 0-filled."""
    return _dense(spark, sf, "month")


@register("dense_panel_daily", with_(ACT, _dense_sql("day", "DAY")) + """
SELECT actor_id, period, n_activities FROM dense""")
def q_dense_panel_daily(spark, sf):
    """D23 at day grain."""
    return _dense(spark, sf, "day")


@register("trailing_sums", with_(ACT, _dense_sql("month", "MONTH")) + f"""
SELECT actor_id, period,
       {_TR}
FROM dense""")
def q_trailing_sums(spark, sf):
    """1/3/6/9/12-month sums before the current month."""
    return trailing_activity(spark, sf)


def trailing_activity(spark, sf, ids=None, months=None):
    """Trailing sums of every actor and month, or of ``ids`` and the range of ``months`` only."""
    sums = pn.trailing_sums(_dense(spark, sf, "month", ids), "actor_id", "period", "n_activities", C.trailing_sizes)
    return sums if months is None else sums.where(F.col("period").between(*months))


MONTHLY_ACTIVITY_SQL = _dense_sql("month", "MONTH").strip() + f""",
act_trailing AS (SELECT actor_id, period,
       {_TR}
FROM dense)"""


@register("trailing_sums_daily", with_(ACT, _dense_sql("day", "DAY")) + f"""
SELECT actor_id, period,
       {_TR}
FROM dense""")
def q_trailing_sums_daily(spark, sf):
    """D24 / W1 at day grain: sums over the 1/3/6/9/12 days before."""
    return pn.trailing_sums(_dense(spark, sf, "day"), "actor_id", "period", "n_activities", C.trailing_sizes)


def _recency_sql(lag: int, cumulative: bool = False) -> str:
    lo, hi = _mi(C.study_start), _mi(C.study_end)
    if cumulative:
        bucket = "b.bucket"
        cond = "gap > 0 AND gap <= b.edge"
        extra = ", (VALUES (1, 'LAST_1M'), (3, 'LAST_3M'), (6, 'LAST_6M'), (9, 'LAST_9M'), (12, 'LAST_12M')) b(edge, bucket)"
    else:
        bucket = ("CASE WHEN gap <= 1 THEN 'LAST_1M' WHEN gap <= 3 THEN 'LAST_3M' WHEN gap <= 6 THEN 'LAST_6M' "
                  "WHEN gap <= 9 THEN 'LAST_9M' ELSE 'LAST_12M' END")
        cond = "gap > 0 AND gap <= 12"
        extra = ""
    return with_(EV) + f"""
, fan AS (
  SELECT ev.actor_id, ev.subject_id, c.c AS ci, c.c - {lag} - ev.mi AS gap
  FROM ev, (SELECT unnest(generate_series({lo}, {hi})) AS c) c
  WHERE c.c - {lag} - ev.mi > 0 AND c.c - {lag} - ev.mi <= 12
)
SELECT actor_id, {_mstr('ci')} AS cohort_month, {bucket} AS bucket,
       count(*) AS n_events, count(DISTINCT subject_id) AS n_subjects
FROM fan{extra} WHERE {cond}
GROUP BY 1, 2, 3"""


def _recency(spark, sf, lag, cumulative=False):
    start = f"{month_before(C.study_start, lag + max(C.bucket_edges))}-01"  # earlier events inform no cohort month
    per = pn.recency_counts(event_log(spark, sf, start, C.study_end_date), lag, C.study_start, C.study_end, C.bucket_edges, cumulative)
    return per.select("actor_id", pn.cohort_month(), pn.bucket_name(), "n_events", "n_subjects")


@register("recency_buckets", _recency_sql(0))
def q_recency_buckets(spark, sf):
    """Events and subjects per actor, cohort month and disjoint recency bucket (lag 0)."""
    return _recency(spark, sf, 0)


@register("recency_buckets_lag2", _recency_sql(C.lag_months))
def q_recency_buckets_lag2(spark, sf):
    """Same with the anchor moved 2 months back (data availability lag)."""
    return _recency(spark, sf, C.lag_months)


@register("recency_buckets_cumulative", _recency_sql(0, cumulative=True))
def q_recency_buckets_cumulative(spark, sf):
    """D25 option: cumulative buckets (a gap counts in every bucket that covers it)."""
    return _recency(spark, sf, 0, cumulative=True)


WEEK_SQL = f"""
wk AS (
  SELECT subject_id, CAST(date_trunc('week', event_date) AS DATE) AS week,
         sum(CASE WHEN product = '{T}' THEN quantity ELSE 0 END) AS qty_target,
         sum(quantity) AS qty_total
  FROM ev WHERE event_date >= DATE '{C.study_start_date}' AND event_date <= DATE '{C.study_end_date}'
  GROUP BY 1, 2
),
wgrid AS (
  SELECT s.subject_id, CAST(w.w AS DATE) AS week
  FROM (SELECT DISTINCT subject_id FROM wk) s,
       (SELECT unnest(generate_series(CAST(date_trunc('week', DATE '{C.study_start_date}') AS DATE),
                                      CAST(date_trunc('week', DATE '{C.study_end_date}') AS DATE),
                                      INTERVAL 7 DAY)) AS w) w
),
wdense AS (
  SELECT g.subject_id, g.week, coalesce(k.qty_target, 0) AS qty_target, coalesce(k.qty_total, 0) AS qty_total
  FROM wgrid g LEFT JOIN wk k ON g.subject_id = k.subject_id AND g.week = k.week
)"""


def weekly_dense(spark, sf):
    ev = event_log(spark, sf).filter(
        (F.col("event_date") >= F.to_date(F.lit(C.study_start_date)))
        & (F.col("event_date") <= F.to_date(F.lit(C.study_end_date))))
    wk = (ev.withColumn("week", week_start("event_date"))
            .groupBy("subject_id", "week")
            .agg(F.sum(F.when(F.col("product") == T, F.col("quantity")).otherwise(0.0)).alias("qty_target"),
                 F.sum("quantity").alias("qty_total")))
    return pn.dense_panel(wk, "subject_id", "week", ["qty_target", "qty_total"],
                          week_start(F.to_date(F.lit(C.study_start_date))),
                          week_start(F.to_date(F.lit(C.study_end_date))), "interval 1 week")


@register("rolling_stddev", with_(EV, WEEK_SQL) + """
SELECT subject_id, strftime(week, '%Y-%m-%d') AS week, qty_target, qty_total,
       stddev_samp(qty_target) OVER w AS std_4_qty_target,
       stddev_samp(qty_total) OVER w AS std_4_qty_total
FROM wdense
WINDOW w AS (PARTITION BY subject_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def q_rolling_stddev(spark, sf):
    """Dense subject x week panel, trailing 4-week sample stddev."""
    return pn.rolling_stddev(weekly_dense(spark, sf), "subject_id", "week", ["qty_target", "qty_total"], 4)


RATES_SQL = f"""
rates AS (
  SELECT actor_id, month,
         sum(CASE WHEN {FLAGS_SQL['use']} THEN 1 ELSE 0 END) AS use_cnt,
         sum(CASE WHEN {FLAGS_SQL['open']} THEN 1 ELSE 0 END) AS open_cnt,
         sum(CASE WHEN {FLAGS_SQL['use']} THEN 1 ELSE 0 END) * 1.0 / count(*) AS use_pct,
         sum(CASE WHEN {FLAGS_SQL['open']} THEN 1 ELSE 0 END) * 1.0 / count(*) AS open_pct
  FROM ev GROUP BY actor_id, month
)"""


@register("use_type_rates", with_(EV, RATES_SQL) + """
SELECT actor_id, month, CAST(use_cnt AS BIGINT) AS use_cnt, CAST(open_cnt AS BIGINT) AS open_cnt,
       use_pct, open_pct FROM rates""")
def q_use_type_rates(spark, sf):
    """Per actor-month count and share of use-type '1' rows and open rows."""
    return pn.use_type_rates(event_log(spark, sf), _flags())


@register("use_type_trailing", with_(EV, RATES_SQL) + f"""
, grid AS (
  SELECT a.actor_id, m.mi FROM (SELECT DISTINCT actor_id FROM rates) a,
       (SELECT unnest(generate_series({_mi(C.first_month)}, {_mi(C.study_end)})) AS mi) m
),
d AS (
  SELECT g.actor_id, g.mi, coalesce(r.use_cnt, 0) AS use_cnt, coalesce(r.open_cnt, 0) AS open_cnt,
         coalesce(r.use_pct, 0) AS use_pct, coalesce(r.open_pct, 0) AS open_pct
  FROM grid g LEFT JOIN rates r ON g.actor_id = r.actor_id AND {_mstr('g.mi')} = r.month
)
SELECT actor_id, {_mstr('mi')} AS month,
       CAST(coalesce(sum(use_cnt) OVER w, 0) AS BIGINT) AS use_cnt_sum12,
       CAST(coalesce(sum(open_cnt) OVER w, 0) AS BIGINT) AS open_cnt_sum12,
       coalesce(sum(use_pct) OVER w, 0) / least(row_number() OVER w0, 12) AS use_pct_mean12,
       coalesce(sum(open_pct) OVER w, 0) / least(row_number() OVER w0, 12) AS open_pct_mean12
FROM d
WINDOW w AS (PARTITION BY actor_id ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING),
       w0 AS (PARTITION BY actor_id ORDER BY mi)""")
def q_use_type_trailing(spark, sf):
    """Dense actor x month, trailing-12 sums and leading-zero means."""
    rates = pn.use_type_rates(event_log(spark, sf), _flags())
    return pn.use_type_trailing(rates, ["use", "open"], C.first_month, C.study_end)


_BR = ",\n         ".join(
    f"count(DISTINCT CASE WHEN {CLASS_SQL} = '{c}' THEN coalesce(product, 'UNKNOWN') END) AS n_{c}"
    for c in CLASSES)
_BRS = ",\n       ".join(
    f"CAST(coalesce(sum(n_{c}) OVER w, 0) AS BIGINT) AS n_{c}_sum12" for c in CLASSES)
_BRC = ", ".join(f"coalesce(b.n_{c}, 0) AS n_{c}" for c in CLASSES)


@register("class_breadth_trailing", with_(EV) + f"""
, br AS (
  SELECT actor_id, year(event_date) * 12 + month(event_date) - 1 AS mi,
         {_BR}
  FROM ev GROUP BY 1, 2
),
grid AS (
  SELECT a.actor_id, m.mi FROM (SELECT DISTINCT actor_id FROM br) a,
       (SELECT unnest(generate_series({_mi(C.first_month)}, {_mi(C.study_end)})) AS mi) m
),
d AS (SELECT g.actor_id, g.mi, {_BRC} FROM grid g LEFT JOIN br b ON g.actor_id = b.actor_id AND g.mi = b.mi)
SELECT actor_id, {_mstr('mi')} AS month,
       {_BRS}
FROM d WINDOW w AS (PARTITION BY actor_id ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def q_class_breadth_trailing(spark, sf):
    """Distinct products per class per month, dense, trailing-12 sum."""
    return pn.class_breadth_trailing(event_log(spark, sf), CLASSES, C.first_month, C.study_end)
