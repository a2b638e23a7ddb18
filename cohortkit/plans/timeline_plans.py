"""Subject / actor timeline queries (weekly history, therapy timeline, heavy users, switchers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.config import TEST_CONFIG as C
from cohortkit.functions.dates import week_start
from cohortkit.operators import panel as pn
from cohortkit.operators import ranges as rg
from cohortkit.operators import timeline as tl
from cohortkit.operators.shape import col_name, long_to_wide
from cohortkit.plans.oracle_sql import EV, with_
from cohortkit.plans.panel_plans import WEEK_SQL, weekly_dense
from cohortkit.plans.registry import register
from cohortkit.session import materialize
from cohortkit.sources.roles import event_log

T = C.target_product
ALL_BRANDS = [f"Brand#{i}" for i in range(1, 26)]   # the part table's brand domain
USES = ("0", "1", "UNK")
LABELS = [tl.quantity_label(p, u) for p in ALL_BRANDS for u in USES] + [tl.OTHER_LABEL]
OTHERS = C.product_groups[0][1]
OWN_BRANDS = ("Brand#12", "Brand#13", "Brand#14")
SWITCH_YEAR = 2000
TOP_N = 20
PROBS = (0.25, 0.5, 0.75, 0.9)

WK_SQL = """
wq AS (
  SELECT subject_id, product, coalesce(use_flag, '1') AS use, CAST(date_trunc('week', event_date) AS DATE) AS week,
         sum(quantity) AS quantity
  FROM ev WHERE product IS NOT NULL GROUP BY 1, 2, 3, 4
)"""
WIDE_SQL = WK_SQL + ",\nwide AS (SELECT subject_id, week, " + ", ".join(
    f"coalesce(sum(CASE WHEN label = '{v}' THEN quantity END), 0) AS {col_name(v)}"
    for v in LABELS) + f""" FROM (
  SELECT *, CASE WHEN 'QTY_' || product || '_USE_' || use IN ({", ".join(f"'{v}'" for v in LABELS)})
                 THEN 'QTY_' || product || '_USE_' || use ELSE '{tl.OTHER_LABEL}' END AS label FROM wq) wl
  GROUP BY subject_id, week)"""
WEEKS_SQL = "wc AS (SELECT subject_id, count(DISTINCT week) AS week_cnt FROM wq GROUP BY subject_id)"
TL_SQL = f"""
aw0 AS (
  SELECT actor_id, subject_id, product, coalesce(use_flag, '1') AS raw_use,
         CAST(date_trunc('week', event_date) AS DATE) AS week, sum(quantity) AS quantity
  FROM ev WHERE product IS NOT NULL GROUP BY 1, 2, 3, 4, 5
),
aw AS (
  SELECT actor_id, subject_id, product, CASE WHEN raw_use = 'UNK' THEN '0' ELSE raw_use END AS use,
         week, quantity FROM aw0
),
tl0 AS (
  SELECT *, product || '-' || use AS label,
         lag(week) OVER (PARTITION BY actor_id, subject_id ORDER BY week, product || '-' || use, quantity) AS prev_week,
         min(week) OVER (PARTITION BY actor_id, subject_id) AS first_week,
         min(CASE WHEN week >= DATE '{C.study_start_date}' THEN week END)
           OVER (PARTITION BY actor_id, subject_id) AS first_after
  FROM aw
),
tl AS (
  SELECT actor_id, subject_id, product, use, label, week, quantity, prev_week, first_week,
         coalesce(CAST(datediff('day', prev_week, week) // 7 AS INTEGER), 0) AS weeks_since_prev,
         coalesce(CAST(datediff('day', first_week, week) // 7 AS INTEGER), 0) AS weeks_since_first,
         CASE WHEN week = first_after THEN '||' ELSE '' END AS marker
  FROM tl0
),
hs AS (
  SELECT actor_id, subject_id, string_agg(marker || label, ', ' ORDER BY week, label) AS history,
         max(weeks_since_prev) AS max_gap_weeks, max(weeks_since_first) AS total_weeks
  FROM tl GROUP BY actor_id, subject_id
)"""


def _ev(spark, sf):
    return event_log(spark, sf)


def _weekly(spark, sf):
    return tl.weekly_quantity(_ev(spark, sf))


@register("weekly_quantity", with_(EV, WK_SQL) + """
SELECT subject_id, product, use, strftime(week, '%Y-%m-%d') AS week, quantity FROM wq""")
def q_weekly_quantity(spark, sf):
    """Quantity per subject, product, use and Monday week."""
    return _weekly(spark, sf)


@register("weekly_quantity_actor", with_(EV) + """
SELECT actor_id, subject_id, product, coalesce(use_flag, '1') AS use,
       strftime(CAST(date_trunc('week', event_date) AS DATE), '%Y-%m-%d') AS week, sum(quantity) AS quantity
FROM ev WHERE product IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
def q_weekly_quantity_actor(spark, sf):
    """Actor-level weekly quantity."""
    return tl.weekly_quantity(_ev(spark, sf), ("actor_id", "subject_id"))


@register("market_overview", with_(EV, WK_SQL) + "\nSELECT strftime(week, '%Y-%m') AS month, " + ", ".join(
    f"count(DISTINCT CASE WHEN product = '{p}' THEN subject_id END) AS {col_name(p, 'subjects')}, "
    f"sum(CASE WHEN product = '{p}' THEN quantity END) AS {col_name(p, 'quantity')}" for p in ALL_BRANDS)
    + " FROM wq GROUP BY 1")
def q_market_overview(spark, sf):
    """Month x product subjects and quantity, wide by product."""
    return tl.market_overview(_weekly(spark, sf), ALL_BRANDS)


@register("weekly_wide", with_(EV, WIDE_SQL) + "\nSELECT subject_id, strftime(week, '%Y-%m-%d') AS week, "
          + ", ".join(col_name(v) for v in LABELS) + " FROM wide")
def q_weekly_wide(spark, sf):
    """Subject x week quantity by product x use, wide."""
    return tl.weekly_wide(_weekly(spark, sf), LABELS)


_Q = ", ".join(f"quantile_cont(week_cnt, {p}) AS q{int(round(p * 100)):02d}" for p in PROBS)


@register("active_week_quantiles", with_(EV, WK_SQL, WEEKS_SQL) + f"\nSELECT {_Q} FROM wc")
def q_active_week_quantiles(spark, sf):
    """Exact quantiles of active weeks per subject."""
    return rg.quantiles(tl.active_weeks(_weekly(spark, sf)), "week_cnt", PROBS)


@register("active_week_quantiles_approx", with_(EV, WK_SQL, WEEKS_SQL) + "\n" + "\nUNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS prob, count(*) AS n, true AS within_error FROM wc" for p in PROBS))
def q_active_week_quantiles_approx(spark, sf):
    """Approximate quantiles by mergeable sketches, judged by their rank: at most 1 % of n off."""
    weeks = tl.active_weeks(_weekly(spark, sf))
    errors = rg.rank_errors(weeks, "week_cnt", rg.approx_quantiles(weeks, "week_cnt", PROBS, 0.01))
    return errors.select("prob", "n", (F.col("rank_error") <= 0.01).alias("within_error"))


@register("subjects_38_weeks", with_(EV, WK_SQL, WEEKS_SQL) + "\nSELECT subject_id, week_cnt FROM wc WHERE week_cnt >= 38")
def q_subjects_38_weeks(spark, sf):
    """Subjects active in at least 38 weeks."""
    return tl.active_weeks(_weekly(spark, sf)).filter(F.col("week_cnt") >= 38)


_STD_COLS = [col_name(v) for v in LABELS]


@register("quantity_stddev", with_(EV, WIDE_SQL, WEEKS_SQL) + "\n, sd AS (SELECT subject_id, " + ", ".join(
    f"stddev_samp({c}) AS std_{c}" for c in _STD_COLS) + " FROM wide GROUP BY subject_id)\n"
    "SELECT sd.*, " + " + ".join(f"coalesce(std_{c}, 0)" for c in _STD_COLS) + " AS row_total\n"
    "FROM sd WHERE subject_id IN (SELECT subject_id FROM wc WHERE week_cnt >= 38)")
def q_quantity_stddev(spark, sf):
    """Per-subject stddev of each weekly column and their row total (>= 38 weeks)."""
    # the wide rows are one for each active week
    sd = tl.column_stddevs(tl.weekly_wide(_weekly(spark, sf), LABELS), "subject_id", _STD_COLS, week_cnt=F.count("week"))
    return sd.filter((F.col("week_cnt") >= 38) & F.col("subject_id").isNotNull()).drop("week_cnt")


@register("rolling_stddev_quantiles", with_(EV, WEEK_SQL) + """
, rs AS (SELECT stddev_samp(qty_total) OVER (PARTITION BY subject_id ORDER BY week
                ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS s FROM wdense)
SELECT """ + ", ".join(f"quantile_cont(s, {p}) AS q{int(round(p * 100)):02d}" for p in PROBS + (1.0,)) + " FROM rs")
def q_rolling_stddev_quantiles(spark, sf):
    """Quantiles of the trailing 4-week stddev of weekly quantity."""
    rs = pn.rolling_stddev(weekly_dense(spark, sf), "subject_id", "week", ["qty_total"], 4)
    return rg.quantiles(rs, "std_4_qty_total", PROBS + (1.0,))


_QTY = {p: col_name("QTY", p) for p in ALL_BRANDS}
PRODUCT_WEEK_SQL = f"""
pw AS (SELECT subject_id, CAST(date_trunc('week', event_date) AS DATE) AS week, {", ".join(
    f"sum(CASE WHEN product = '{p}' THEN quantity END) AS {c}" for p, c in _QTY.items())}
  FROM ev WHERE event_date >= DATE '{C.study_start_date}' AND event_date <= DATE '{C.study_end_date}' GROUP BY 1, 2),
pgrid AS (
  SELECT s.subject_id, CAST(w.w AS DATE) AS week FROM (SELECT DISTINCT subject_id FROM pw) s,
       (SELECT unnest(generate_series(CAST(date_trunc('week', DATE '{C.study_start_date}') AS DATE),
                                      CAST(date_trunc('week', DATE '{C.study_end_date}') AS DATE), INTERVAL 7 DAY)) AS w) w),
pstd AS (
  SELECT g.subject_id, g.week, {", ".join(
      f"stddev_samp(coalesce(p.{c}, 0)) OVER w AS std_4_{c}" for c in _QTY.values())}
  FROM pgrid g LEFT JOIN pw p ON p.subject_id = g.subject_id AND p.week = g.week
  WINDOW w AS (PARTITION BY g.subject_id ORDER BY g.week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""


def product_stddevs(spark, sf):
    """Dense subject x week panel of the study with the trailing stddev of every product's quantity."""
    ev = event_log(spark, sf, C.study_start_date, C.study_end_date).withColumn("week", week_start("event_date"))
    wide = long_to_wide(ev, ["subject_id", "week"], "product", "quantity", ALL_BRANDS, agg="sum", prefix="QTY", fill=0)
    dense = pn.dense_panel(wide, "subject_id", "week", list(_QTY.values()), week_start(F.to_date(F.lit(C.study_start_date))),
                           week_start(F.to_date(F.lit(C.study_end_date))), "interval 1 week")
    return pn.rolling_stddev(dense, "subject_id", "week", list(_QTY.values()), 4)


@register("rolling_stddev_products", with_(EV, PRODUCT_WEEK_SQL) + "\nSELECT subject_id, strftime(week, '%Y-%m-%d') AS week, "
          + ", ".join(f"std_4_{c}" for c in _QTY.values()) + " FROM pstd")
def q_rolling_stddev_products(spark, sf):
    """Trailing 4-week stddev of each product's weekly quantity, per subject."""
    return product_stddevs(spark, sf).select("subject_id", "week", *[f"std_4_{c}" for c in _QTY.values()])


@register("rolling_stddev_product_quantiles", with_(EV, PRODUCT_WEEK_SQL) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{p}' AS product, CAST({q} AS DOUBLE) AS prob, count(std_4_{c}) AS n, quantile_cont(std_4_{c}, {q}) AS quantile FROM pstd"
    for p, c in _QTY.items() for q in PROBS))
def q_rolling_stddev_product_quantiles(spark, sf):
    """Quantiles of every product's trailing stddev, all products in one search."""
    rs = product_stddevs(spark, sf)
    long = rs.select(*[F.col(f"std_4_{c}").alias(p) for p, c in _QTY.items()]).unpivot([], list(_QTY), "product", "value")
    return rg.quantiles_long(long, "product", "value", PROBS)


def _timeline(spark, sf):
    return tl.therapy_timeline(_ev(spark, sf), C.study_start_date)


@register("therapy_timeline", with_(EV, TL_SQL) + """
SELECT actor_id, subject_id, product, use, label, strftime(week, '%Y-%m-%d') AS week, quantity,
       strftime(prev_week, '%Y-%m-%d') AS prev_week, strftime(first_week, '%Y-%m-%d') AS first_week,
       CAST(weeks_since_prev AS BIGINT) AS weeks_since_prev, CAST(weeks_since_first AS BIGINT) AS weeks_since_first,
       marker
FROM tl""")
def q_therapy_timeline(spark, sf):
    """Weekly timeline with gaps and the first-after-threshold marker."""
    return _timeline(spark, sf)


@register("history_string", with_(EV, TL_SQL) + """
SELECT actor_id, subject_id, history, CAST(max_gap_weeks AS BIGINT) AS max_gap_weeks,
       CAST(total_weeks AS BIGINT) AS total_weeks FROM hs""")
def q_history_string(spark, sf):
    """Ordered history string, longest gap, duration per pair."""
    return tl.history_string(_timeline(spark, sf))


@register("first_subject", with_(EV, TL_SQL) + f"""
, fs AS (
  SELECT actor_id, arg_min(subject_id, (event_date, subject_id)) AS subject_id, min(event_date) AS first_date
  FROM ev WHERE product = '{T}' AND event_date >= DATE '{C.study_start_date}' AND event_date <= DATE '{C.study_end_date}'
  GROUP BY actor_id
)
SELECT fs.actor_id, fs.subject_id, strftime(fs.first_date, '%Y-%m-%d') AS first_date, hs.history,
       CAST(hs.max_gap_weeks AS BIGINT) AS max_gap_weeks, CAST(hs.total_weeks AS BIGINT) AS total_weeks
FROM fs LEFT JOIN hs ON fs.actor_id = hs.actor_id AND fs.subject_id = hs.subject_id""")
def q_first_subject(spark, sf):
    """Each actor's first target subject in the study, with that pair's history."""
    firsts = event_log(spark, sf, C.study_start_date, C.study_end_date, product=T)
    fs = materialize(tl.first_subject(firsts, T, C.study_start_date, C.study_end_date), "first_subjects")
    # a timeline is of one (actor, subject) pair: only the events of the pairs asked for
    ev = _ev(spark, sf).join(fs.select("actor_id", "subject_id"), ["actor_id", "subject_id"], "left_semi")
    hs = tl.history_string(tl.therapy_timeline(ev, C.study_start_date))
    return fs.join(hs, ["actor_id", "subject_id"], "left")


@register("top_users_dense_rank", with_(EV, WK_SQL) + f"""
, cnt AS (SELECT subject_id, count(*) AS record_count FROM wq WHERE product = '{T}' AND use IS NOT NULL
          GROUP BY subject_id),
rk AS (SELECT subject_id, record_count, dense_rank() OVER (ORDER BY record_count DESC) AS rank FROM cnt)
SELECT wq.subject_id, wq.product, wq.use, strftime(wq.week, '%Y-%m-%d') AS week, wq.quantity,
       rk.record_count, rk.rank
FROM wq JOIN rk ON wq.subject_id = rk.subject_id WHERE rk.rank <= {TOP_N}""")
def q_top_users_dense_rank(spark, sf):
    """Weekly rows of heavy target users (dense rank <= 20, ties kept)."""
    return tl.top_users_dense_rank(_weekly(spark, sf), T, TOP_N)


@register("top_users_with_other", with_(EV, WK_SQL) + f"""
SELECT subject_id, count(*) AS record_count FROM wq
WHERE product = '{T}' AND use IS NOT NULL
  AND subject_id IN (SELECT subject_id FROM wq WHERE product IN ({", ".join(f"'{p}'" for p in OTHERS)}))
GROUP BY subject_id ORDER BY record_count DESC, subject_id LIMIT {TOP_N}""")
def q_top_users_with_other(spark, sf):
    """Top-20 target users (count desc, id asc) among users of the other products."""
    return tl.top_users_with_other(_weekly(spark, sf), T, OTHERS, TOP_N)


@register("switchers", with_(EV, WK_SQL) + f"""
, ft AS (SELECT subject_id, min(CASE WHEN product = '{T}' THEN week END) AS ftw FROM wq GROUP BY subject_id),
el AS (SELECT DISTINCT wq.subject_id FROM wq JOIN ft ON wq.subject_id = ft.subject_id
       WHERE ft.ftw IS NOT NULL AND wq.week < ft.ftw AND wq.product NOT IN ({", ".join(f"'{p}'" for p in OWN_BRANDS)}))
SELECT subject_id, product, use, strftime(week, '%Y-%m-%d') AS week, quantity FROM wq
WHERE subject_id IN (SELECT subject_id FROM el) AND product = '{T}' AND year(week) = {SWITCH_YEAR}""")
def q_switchers(spark, sf):
    """Target rows in the given year of subjects who used another brand first."""
    return tl.switchers(_weekly(spark, sf), T, OWN_BRANDS, SWITCH_YEAR)
