"""Quality, profile and exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.config import TEST_CONFIG as C
from cohortkit.operators import quality as qa
from cohortkit.plans.oracle_sql import ACT, EV, with_
from cohortkit.plans.registry import register
from cohortkit.functions.dates import parse_date, string_date_window
from cohortkit.operators.shape import long_to_wide
from cohortkit.session import materialize, shared_path
from cohortkit.sources.roles import activity_log, channel_log, event_log
from cohortkit.sources.tables import describe_table, read_table, read_written, write_table

T = C.target_product
STRING_WINDOW = ("2024-01-10", "2024-01-21")
PROFILE_COLS = ["actor_id", "subject_id", "month", "product", "product_group", "use_flag",
                "source", "institution"]
CLEAN_COLS = ["actor_id", "subject_id", "event_date", "month", "product", "product_group",
              "quantity", "use_flag", "source", "institution", "birth_year_alt"]
DUP_COLS = ["actor_id", "subject_id", "month", "product"]
NUM_COLS = ["quantity", "birth_year", "birth_year_alt"]
ALL_EV = ("actor_id, subject_id, strftime(event_date, '%Y-%m-%d') AS event_date, month, product, "
          "product_group, quantity, use_flag, source, institution, birth_year, birth_year_alt, "
          "order_key, line_number")


def _ev(spark, sf):
    return event_log(spark, sf)


@register("clean_events", with_(EV) + """
SELECT month, actor_id, subject_id, strftime(event_date, '%Y-%m-%d') AS event_date, product, product_group,
       quantity, use_flag, source, coalesce(institution, 'UNK') AS institution_code, birth_year_alt
FROM ev WHERE subject_id NOT IN (
  SELECT subject_id FROM ev GROUP BY subject_id HAVING count(DISTINCT birth_year_alt) > 1)""")
def q_clean_events(spark, sf):
    """Shortlist, fill, drop conflicted subjects, rename, month first."""
    return qa.clean_events(_ev(spark, sf), CLEAN_COLS, "subject_id", "birth_year_alt",
                           fill={"institution": "UNK"}, rename={"institution": "institution_code"},
                           move_after=("month", None))


@register("conflicting_entities", with_(EV) + """
SELECT subject_id, count(DISTINCT birth_year_alt) AS n_values FROM ev
GROUP BY subject_id HAVING count(DISTINCT birth_year_alt) > 1""")
def q_conflicting_entities(spark, sf):
    """Subjects with more than one birth year."""
    return qa.find_conflicting(_ev(spark, sf), "subject_id", "birth_year_alt")


@register("drop_conflicting_entities", with_(EV) + f"""
SELECT {ALL_EV} FROM ev WHERE subject_id NOT IN (
  SELECT subject_id FROM ev GROUP BY subject_id HAVING count(DISTINCT birth_year_alt) > 1)""")
def q_drop_conflicting_entities(spark, sf):
    """The event log without conflicted subjects (anti-join)."""
    return qa.drop_conflicting(_ev(spark, sf), "subject_id", "birth_year_alt")


@register("source_mismatch", with_(EV) + """
, per AS (SELECT subject_id, count(*) AS n_mismatch FROM ev
  WHERE birth_year IS NOT NULL AND birth_year_alt IS NOT NULL AND birth_year <> birth_year_alt
  GROUP BY subject_id)
SELECT subject_id, n_mismatch,
       CAST(CASE WHEN n_mismatch = (SELECT max(n_mismatch) FROM per) THEN 1 ELSE 0 END AS BIGINT) AS is_max
FROM per""")
def q_source_mismatch(spark, sf):
    """D3: two-source birth-year mismatches per subject, arg-max flagged."""
    return qa.source_mismatch(_ev(spark, sf), "subject_id", "birth_year", "birth_year_alt")


@register("duplicate_rows", with_(EV) + """
SELECT actor_id, subject_id, month, product, count(*) AS n_copies
FROM ev GROUP BY actor_id, subject_id, month, product HAVING count(*) > 1""")
def q_duplicate_rows(spark, sf):
    """Identical rows over the shortlist."""
    return qa.duplicate_rows(_ev(spark, sf), DUP_COLS)


_PROF_SEL = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in PROFILE_COLS)
# long form with nulls kept (one SELECT per column)
_PROF_LONG = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ev" for c in PROFILE_COLS)
_PROF_ON = ", ".join(PROFILE_COLS)


@register("table_profile", with_(EV) + f"""
, lng AS (
  {_PROF_LONG}
),
stats AS (
  SELECT column_name, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS n_null,
         count(DISTINCT value) AS n_distinct
  FROM lng GROUP BY column_name
),
cnt AS (SELECT column_name, value, count(*) AS n FROM lng WHERE value IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM cnt),
top AS (SELECT column_name, string_agg(value, ', ' ORDER BY r) AS top_values FROM rk WHERE r <= 3 GROUP BY 1)
SELECT s.column_name, round(s.n_null * 100.0 / (SELECT count(*) FROM ev), 6) AS null_pct,
       s.n_distinct, t.top_values
FROM stats s LEFT JOIN top t ON s.column_name = t.column_name""")
def q_table_profile(spark, sf):
    """Null %, distinct count, top-3 values per column."""
    return qa.table_profile(_ev(spark, sf), PROFILE_COLS, 3)


@register("null_counts", with_(EV) + f"""
, lng AS (
  {_PROF_LONG}
)
SELECT column_name, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
       round(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS null_pct
FROM lng GROUP BY column_name""")
def q_null_counts(spark, sf):
    """Null count and percent per column."""
    return qa.null_counts(_ev(spark, sf), PROFILE_COLS)


@register("rows_with_nulls", with_(EV) + f"""
SELECT {ALL_EV} FROM ev WHERE institution IS NULL OR product IS NULL OR subject_id IS NULL""")
def q_rows_with_nulls(spark, sf):
    """Rows with a null in any checked column."""
    return qa.rows_with_nulls(_ev(spark, sf), ["institution", "product", "subject_id"])


@register("drop_all_null_columns", with_(EV) + """
, agg AS (SELECT count(actor_id) AS actor_id, count(institution) AS institution,
                 count(CAST(NULL AS VARCHAR)) AS unused_code FROM ev)
SELECT column_name, n_non_null FROM (UNPIVOT agg ON actor_id, institution, unused_code
  INTO NAME column_name VALUE n_non_null) WHERE n_non_null = 0""")
def q_drop_all_null_columns(spark, sf):
    """Columns that are entirely null (here the placeholder column)."""
    ev = _ev(spark, sf).select("actor_id", "institution",
                               F.lit(None).cast("string").alias("unused_code"))
    return qa.drop_all_null_columns(ev)


@register("non_null_columns", with_(EV) + """
SELECT actor_id, subject_id, strftime(event_date, '%Y-%m-%d') AS event_date, product, source FROM ev WHERE source = 'F'""")
def q_non_null_columns(spark, sf):
    """P14 applied: rows of a source that names no institution, without the columns that are all null there."""
    ev = _ev(spark, sf).select("actor_id", "subject_id", "event_date", "product", "source", "institution",
                               F.lit(None).cast("string").alias("unused_code"))
    return qa.select_non_null_columns(ev.where("source = 'F'"))


_SHAPE = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_shipdate", "timestamp_ntz"),
          ("l_returnflag", "string"), ("l_quantity", "double")]


@register("table_shape", "\nUNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count({c}) AS n_values FROM lineitem"
    for i, (c, t) in enumerate(_SHAPE)))
def q_table_shape(spark, sf):
    """Columns of a table with their types, the number of rows and of values."""
    return describe_table(read_table(spark, sf, "lineitem", [c for c, _ in _SHAPE]))


def string_dated(spark, sf):
    """The channel log written with its day as text, once with the year first and once with the year last."""
    log = channel_log(spark, sf)
    year_last = F.concat(F.substring("date_key", 5, 4), F.substring("date_key", 1, 4))
    return materialize(log.select("actor_key", "channel", F.col("date_key").alias("ymd"), year_last.alias("mdy")), "string_dated")


@register("string_window_scan", with_(ACT) + "\nUNION ALL ".join(f"""
SELECT '{fmt}' AS format, strftime(event_date, '%Y-%m-%d') AS day, count(*) AS n_rows, count(DISTINCT actor_id) AS n_actors
FROM act WHERE event_date BETWEEN DATE '{STRING_WINDOW[0]}' AND DATE '{STRING_WINDOW[1]}' GROUP BY event_date
""" for fmt in ("yyyyMMdd", "MMddyyyy")))
def q_string_window_scan(spark, sf):
    """An inclusive date window on two text formats; bounds and year endings reach the scan."""
    log = string_dated(spark, sf)
    out = None
    for name, fmt in (("ymd", "yyyyMMdd"), ("mdy", "MMddyyyy")):
        part = log.where(string_date_window(name, fmt, *STRING_WINDOW)).groupBy(parse_date(name, fmt).alias("day")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("actor_key").alias("n_actors"))
        part = part.select(F.lit(fmt).alias("format"), "day", "n_rows", "n_actors")
        out = part if out is None else out.unionByName(part)
    return out


@register("describe_numeric", with_(EV) + """
, lng AS (UNPIVOT (SELECT CAST(quantity AS DOUBLE) AS quantity, CAST(birth_year AS DOUBLE) AS birth_year,
                          CAST(birth_year_alt AS DOUBLE) AS birth_year_alt FROM ev)
          ON quantity, birth_year, birth_year_alt INTO NAME column_name VALUE v)
SELECT column_name, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS stddev, min(v) AS min, max(v) AS max
FROM lng GROUP BY column_name""")
def q_describe_numeric(spark, sf):
    """Summary statistics of the numeric columns."""
    return qa.describe_numeric(_ev(spark, sf), NUM_COLS)


@register("distinct_counts", with_(EV) + """
SELECT count(DISTINCT actor_id) AS n_actor_id, count(DISTINCT subject_id) AS n_subject_id,
       count(DISTINCT product) AS n_product, count(DISTINCT month) AS n_month FROM ev""")
def q_distinct_counts(spark, sf):
    """A3: several exact distinct counts in one pass."""
    return qa.distinct_counts(_ev(spark, sf), ["actor_id", "subject_id", "product", "month"])


@register("value_share", with_(EV) + """
SELECT product, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 6) AS pct
FROM ev GROUP BY product""")
def q_value_share(spark, sf):
    """Percent of records per product."""
    return qa.value_share(_ev(spark, sf), "product")


@register("value_share_source", with_(EV) + """
SELECT source, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 6) AS pct
FROM ev GROUP BY source""")
def q_value_share_source(spark, sf):
    """Percent of records per source."""
    return qa.value_share(_ev(spark, sf), "source")


@register("source_switch", with_(EV) + """
SELECT subject_id, CAST(max(CASE WHEN birth_year <> birth_year_alt AND source <> 'O' THEN 1 ELSE 0 END) AS BIGINT)
       AS switch_flag
FROM ev GROUP BY subject_id""")
def q_source_switch(spark, sf):
    """Subjects whose two ids differ outside the excluded source."""
    return qa.source_switch(_ev(spark, sf), "subject_id", "birth_year", "birth_year_alt", "source", "O")


@register("monthly_quantity", with_(EV) + """
SELECT month, sum(quantity) AS total_quantity FROM ev GROUP BY month""")
def q_monthly_quantity(spark, sf):
    """Total quantity per month."""
    return qa.monthly_quantity(_ev(spark, sf))


@register("monthly_quantity_target", with_(EV) + f"""
SELECT month, sum(quantity) AS total_quantity FROM ev WHERE product = '{T}' GROUP BY month""")
def q_monthly_quantity_target(spark, sf):
    """Total quantity per month of the target product."""
    return qa.monthly_quantity(_ev(spark, sf), T)


@register("monthly_subjects", with_(EV) + f"""
SELECT month, count(DISTINCT subject_id) AS n_subjects FROM ev WHERE product = '{T}' GROUP BY month""")
def q_monthly_subjects(spark, sf):
    """Distinct subjects of the target per month."""
    return qa.monthly_subjects(_ev(spark, sf), T)


@register("product_reach", with_(EV) + """
SELECT product, count(DISTINCT actor_id) AS n_actors, count(DISTINCT subject_id) AS n_subjects
FROM ev GROUP BY product""")
def q_product_reach(spark, sf):
    """Distinct actors / subjects per product."""
    return qa.product_reach(_ev(spark, sf))


@register("product_reach_by_source", with_(EV) + """
SELECT product, source, count(DISTINCT actor_id) AS n_actors, count(DISTINCT subject_id) AS n_subjects
FROM ev GROUP BY product, source""")
def q_product_reach_by_source(spark, sf):
    """Per product and source."""
    return qa.product_reach(_ev(spark, sf), ("product", "source"))


@register("relationship_degree", with_(EV) + """
, per AS (SELECT subject_id, count(DISTINCT actor_id) AS n_distinct FROM ev GROUP BY subject_id)
SELECT subject_id, n_distinct, dense_rank() OVER (ORDER BY n_distinct DESC) AS degree_rank FROM per""")
def q_relationship_degree(spark, sf):
    """Actors per subject, ranked."""
    return qa.relationship_degree(_ev(spark, sf), "subject_id", "actor_id")


@register("relationship_degree_actor", with_(EV) + """
, per AS (SELECT actor_id, count(DISTINCT subject_id) AS n_distinct FROM ev GROUP BY actor_id)
SELECT actor_id, n_distinct, dense_rank() OVER (ORDER BY n_distinct DESC) AS degree_rank FROM per""")
def q_relationship_degree_actor(spark, sf):
    """Subjects per actor, ranked."""
    return qa.relationship_degree(_ev(spark, sf), "actor_id", "subject_id")


def _cov_sql(two_keys: bool) -> str:
    cond = "ev.actor_id = act.actor_id" + (" AND day(ev.event_date) = day(act.event_date)" if two_keys else "")
    since = f"ev.event_date >= DATE '{C.study_start_date}'"
    return f"""
SELECT '{'actor_day' if two_keys else 'actor'}' AS match_keys,
       CAST(count(*) AS BIGINT) AS matched_rows,
       CAST(count(CASE WHEN {since} THEN 1 END) AS BIGINT) AS matched_rows_since,
       count(DISTINCT ev.subject_id) AS matched_subject_id,
       count(DISTINCT CASE WHEN {since} THEN ev.subject_id END) AS matched_subject_id_since,
       count(DISTINCT ev.actor_id) AS matched_actor_id,
       count(DISTINCT CASE WHEN {since} THEN ev.actor_id END) AS matched_actor_id_since
FROM ev JOIN act ON {cond}"""


@register("source_match_coverage", with_(EV, ACT) + _cov_sql(False) + "\nUNION ALL" + _cov_sql(True))
def q_source_match_coverage(spark, sf):
    """Event log rows, subjects and actors matched in the activity log,
    on one key and on two keys, all time and since the study start."""
    # both kinds of keys read the joined log: written once, three narrow columns
    ev = materialize(_ev(spark, sf).select("actor_id", "subject_id", "event_date"), "event_log")
    act = activity_log(spark, sf)
    one = qa.match_coverage(ev, act, [("actor_id", "actor_id")], "event_date", C.study_start_date)
    ev2 = ev.withColumn("_day", F.dayofmonth("event_date"))
    act2 = act.withColumn("_day", F.dayofmonth("event_date"))
    two = qa.match_coverage(ev2, act2, [("actor_id", "actor_id"), ("_day", "_day")], "event_date",
                            C.study_start_date)
    return (one.select(F.lit("actor").alias("match_keys"), "*")
               .unionByName(two.select(F.lit("actor_day").alias("match_keys"), "*")))


@register("dimension_coverage", with_(ACT) + """
SELECT 'customer' AS dimension, count(DISTINCT a.actor_id) AS n_ids,
       count(DISTINCT CASE WHEN c.c_name IS NOT NULL THEN a.actor_id END) AS n_matched,
       round(count(DISTINCT CASE WHEN c.c_name IS NOT NULL THEN a.actor_id END) * 1.0
             / count(DISTINCT a.actor_id), 6) AS share
FROM act a LEFT JOIN customer c ON a.actor_id = c.c_custkey
UNION ALL
SELECT 'supplier', count(DISTINCT l.l_suppkey),
       count(DISTINCT CASE WHEN s.s_name IS NOT NULL THEN l.l_suppkey END),
       round(count(DISTINCT CASE WHEN s.s_name IS NOT NULL THEN l.l_suppkey END) * 1.0
             / count(DISTINCT l.l_suppkey), 6)
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey""")
def q_dimension_coverage(spark, sf):
    """Share of fact ids with a dimension row (activity users -> customer,
    line suppliers -> supplier)."""
    act = activity_log(spark, sf)
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    a = qa.dimension_coverage(act, "actor_id", cust, "c_custkey", "c_name")
    li = read_table(spark, sf, "lineitem", ["l_suppkey"])
    sup = read_table(spark, sf, "supplier", ["s_suppkey", "s_name"])
    b = qa.dimension_coverage(li, "l_suppkey", sup, "s_suppkey", "s_name")
    return (a.select(F.lit("customer").alias("dimension"), "*")
             .unionByName(b.select(F.lit("supplier").alias("dimension"), "*")))


@register("sample_one_id_history", with_(EV) + f"""
SELECT {ALL_EV} FROM ev WHERE actor_id = (
  SELECT actor_id FROM (SELECT DISTINCT actor_id FROM ev) x
  ORDER BY md5(CAST(actor_id AS VARCHAR) || '{C.seed}'), actor_id LIMIT 1)""")
def q_sample_one_id_history(spark, sf):
    """Every row of one actor picked by a seeded hash order."""
    return qa.sample_one_id(_ev(spark, sf), "actor_id", C.seed)


ROUND_TRIP_SQL = with_(EV) + f"""
SELECT actor_id, subject_id, month, product, quantity FROM ev WHERE product = '{T}'"""


def _target_rows(spark, sf):
    return _ev(spark, sf).filter(F.col("product") == T).select("actor_id", "subject_id", "month", "product", "quantity")


@register("table_round_trip", ROUND_TRIP_SQL)
def q_table_round_trip(spark, sf):
    """Overwrite-write the target rows as parquet partitioned by month to the shared folder and read them back."""
    path = shared_path(spark, "round_trip", "parquet")
    write_table(_target_rows(spark, sf), path, partition_by="month")
    return read_written(spark, path).select("actor_id", "subject_id", "month", "product", "quantity")


@register("csv_round_trip", ROUND_TRIP_SQL)
def q_csv_round_trip(spark, sf):
    """The same rows as CSV with a header; the values of the files are compared."""
    df, path = _target_rows(spark, sf), shared_path(spark, "round_trip", "csv")
    write_table(df, path, fmt="csv")
    return read_written(spark, path, fmt="csv", schema=df.schema)


@register("long_to_wide_domain", with_(EV) + "\nSELECT actor_id, " + ", ".join(
    f"sum(CASE WHEN product = 'Brand#{i}' THEN quantity END) AS Brand_{i}_quantity, "
    f"count(CASE WHEN product = 'Brand#{i}' THEN quantity END) AS Brand_{i}_n" for i in range(1, 26)) + " FROM ev GROUP BY actor_id")
def q_long_to_wide_domain(spark, sf):
    """Two measures per product and actor, the products found by the domain pass."""
    ev = _ev(spark, sf).groupBy("actor_id", "product").agg(F.sum("quantity").alias("quantity"), F.count("quantity").alias("n"))
    # written once for the domain pass and the wide rows
    wide = long_to_wide(materialize(ev, "by_product"), "actor_id", "product", ["quantity", "n"], agg="sum")
    return wide.fillna(0, [c for c in wide.columns if c.endswith("_n")])
