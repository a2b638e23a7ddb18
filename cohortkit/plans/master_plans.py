"""Master table and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.config import TEST_CONFIG as C
from cohortkit.functions.dates import month_before
from cohortkit.operators import cohort as co
from cohortkit.operators import features as fe
from cohortkit.operators import master as ma
from cohortkit.operators import panel as pn
from cohortkit.operators import shape as sh
from cohortkit.plans import feature_plans as fp
from cohortkit.plans import panel_plans as pp
from cohortkit.plans.cohort_plans import spine_cte
from cohortkit.plans.oracle_sql import ACT, AFFL, EV, PROFILE, with_
from cohortkit.plans.registry import register
from cohortkit.session import materialize, shared_path
from cohortkit.sources.roles import activity_log, actor_profile, affiliations, channel_log, event_log
from cohortkit.sources.tables import table_path

T = C.target_product
KEYS = ["actor_id", "cohort_month"]
CHAR_NUM = ["n_subjects"] + [f"{b[0]}_CNT" for b in fe.AGE_BANDS]
ACTIVITY_COLS = [f"prev_{k:02d}_n_activities" for k in C.trailing_sizes]
CHANNEL_COLS = [c for _, _, c in fp._CH_COLS]
BREADTH_COLS = [f"N_{c}_12M" for c in fp.CLASSES]
MONTHLY_COLS = fp._SHARE_COLS + ["org_flag", "peer_flag"]


def master_df(spark, sf):
    """The spine with all features.

    The event log and the spine are written once.  Features are computed for
    the spine's actors only (peers excepted, who may be anyone), from the
    months that can inform a cohort month, for the cohort months that the
    actor has in the spine, and only where there are events: the last fill
    does the rest.
    """
    ev = materialize(event_log(spark, sf).select("actor_id", "subject_id", "event_date", "month", "product", "product_group",
                                                 "use_flag", "institution", "birth_year"), "event_log")
    spine = materialize(co.target_spine(ev, C), "spine")
    members = spine.select("actor_id").distinct()
    # affiliations as known when the study starts
    affl = materialize(affiliations(spark, sf, ev.filter(F.col("event_date") < F.to_date(F.lit(C.study_start_date))))
                       .where("org_rank = 1"), "affiliations")
    first = month_before(C.study_start, C.lag_months + 12)
    wanted = materialize(pn.wanted_cohorts(spine, C.study_start), "wanted")
    recent = materialize(ev.where(F.col("month").between(first, C.study_end)).join(wanted, "actor_id"), "recent")
    shares = fe.share_map(recent, fp.NAMED, fp.GROUPS, C.study_start, C.study_end, C.lag_months, fp.EDGES, dense=False)
    orgf = fe.org_flag(recent.where(F.col("month") >= C.study_start)).withColumnRenamed("month", "cohort_month")
    peer = fe.peer_use_flag(ev.where(F.col("month") >= first), affl, T, C.study_start, C.study_end, C.lag_months, actors=wanted).drop("org_id")
    breadth = fe.class_breadth_lookback(recent, fp.CLASSES, C.study_start, C.study_end, 0, 12, dense=False)
    own = fe.own_use(recent, T, C.study_start, C.study_end, C.lag_months).join(affl.select("actor_id"), "actor_id", "left_semi")
    own_events = ev.join(members, "actor_id", "left_semi")
    counts = fe.subject_counts(own_events, *fp.AGE_YEAR)
    ages = fe.age_band_counts(own_events, fp.AGE_YEAR[0], fp.AGE_YEAR[1], C.as_of_date).drop("PAT_AGE_NA_CNT")
    specialty = fe.specialty_group(actor_profile(spark, sf), codes=fp.SPEC_CODES, fallback_parts=fp.SPEC_PARTS,
                                   fallback_group=fp.SPEC_FALLBACK)
    org = (affl.select("actor_id", "org_id").join(fe.org_size(affl), "org_id", "left").join(members, "actor_id", "left_semi")
               .select("actor_id", "org_id", "account_size"))
    activity = pp.trailing_activity(spark, sf, members, (C.study_start, C.study_end)).withColumnRenamed("period", "cohort_month")
    channel = fe.channel_map_rows(channel_log(spark, sf), wanted, fp.CHANNELS, fp.CH_LO, fp.CH_HI, 0,
                                  fp.EDGES, fp.MEASURES).withColumn("actor_id", F.col("actor_id").cast("long"))
    return ma.master_table(spine, [
        ("activity", activity, KEYS), ("channel", channel, KEYS), ("shares", shares, KEYS), ("org_flag", orgf, KEYS),
        ("peer", peer, KEYS), ("breadth", breadth, KEYS), ("own", own, KEYS), ("subjects", counts, ["actor_id"]),
        ("ages", ages, ["actor_id"]), ("specialty", specialty, ["actor_id"]), ("organisation", org, ["actor_id"])],
        grouped=("channel", "shares", "org_flag", "breadth", "own", "subjects", "ages"),
        expand={"_shares": fe.share_columns(fp.NAMED, fp.GROUPS, fp.EDGES), "_channels": fe.channel_columns(fp.CHANNELS, fp.EDGES, fp.MEASURES)})


_WRITTEN: dict[tuple, str] = {}


def written_master(spark, sf):
    """The run's master table: written to the shared folder once for a session and state of the input tables, then read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(table_path(sf, t)) for t in ("lineitem", "orders", "part", "customer", "supplier", "events")]
    changed = tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)
    key = (spark.sparkContext.applicationId, sf, changed)
    if key not in _WRITTEN:
        _WRITTEN[key] = shared_path(spark, "tables", "master")
        master_df(spark, sf).write.parquet(_WRITTEN[key])
    return spark.read.parquet(_WRITTEN[key])


AFFL_BEFORE = AFFL.replace("FROM ev JOIN supplier s ON ev.subject_id = s.s_suppkey",
                           f"FROM ev JOIN supplier s ON ev.subject_id = s.s_suppkey AND ev.event_date < DATE '{C.study_start_date}'")
MASTER_SQL = ",\n".join([
    spine_cte().strip(), pp.MONTHLY_ACTIVITY_SQL.strip(), fp.CHANNEL_SQL.strip(), fp.SHARE_WIDE_SQL.strip(), fp.ORG_FLAG_SQL, fp.PEER_SQL.strip(), fp.MONTHLY_SQL.strip(),
    fp.BREADTH_SQL.strip(), fp.OWN_SQL.strip(), fp._spec_sql().strip(), fp.AGE_SQL.strip(), fp.CHAR_SQL.strip()]) + """,
master AS (
  SELECT sp.actor_id, sp.cohort_month, CAST(sp.target AS BIGINT) AS target, """ + ", ".join(
    [f"coalesce(av.{c}, 0) AS {c}" for c in ACTIVITY_COLS]
    + [f"coalesce(cn.{c}, 0) AS {c}" for c in CHANNEL_COLS]
    + [f"coalesce(mf.{c}, 0) AS {c}" for c in MONTHLY_COLS]
    + [f"coalesce(br.{c}, 0) AS {c}" for c in BREADTH_COLS]
    + ["coalesce(own.own_flag, 0) AS own_flag"]
    + [f'coalesce(ch."{c}", 0) AS "{c}"' for c in CHAR_NUM]
    + ["sc.specialty", "CAST(mo.org_id AS BIGINT) AS org_id", "coalesce(os.account_size, 0) AS account_size"]) + """
  FROM spine sp
  LEFT JOIN mf ON mf.actor_id = sp.actor_id AND mf.cohort_month = sp.cohort_month
  LEFT JOIN breadth br ON br.actor_id = sp.actor_id AND br.cohort_month = sp.cohort_month
  LEFT JOIN own ON own.actor_id = sp.actor_id AND own.cohort_month = sp.cohort_month
  LEFT JOIN chars ch ON ch.actor_id = sp.actor_id
  LEFT JOIN act_trailing av ON av.actor_id = sp.actor_id AND av.period = sp.cohort_month
  LEFT JOIN chan cn ON cn.actor_id = CAST(sp.actor_id AS VARCHAR) AND cn.cohort_month = sp.cohort_month
  LEFT JOIN spec sc ON sc.actor_id = sp.actor_id
  LEFT JOIN (SELECT actor_id, org_id FROM affl WHERE org_rank = 1) mo ON mo.actor_id = sp.actor_id
  LEFT JOIN osize os ON os.org_id = mo.org_id
)"""
MASTER_WITH = with_(EV, ACT, AFFL_BEFORE, PROFILE, MASTER_SQL)


@register("master_table", MASTER_WITH + "\nSELECT * FROM master")
def q_master_table(spark, sf):
    """Spine ⟕ activity ⟕ channels ⟕ monthly features ⟕ class breadth ⟕ own use ⟕ characteristics
    ⟕ specialty ⟕ main organisation; features 0-filled, identifiers not; every right side checked for unique keys."""
    return master_df(spark, sf)


@register("label_balance", MASTER_WITH + "\nSELECT target, count(*) AS n FROM master GROUP BY target")
def q_label_balance(spark, sf):
    """Class balance of the master table, whose rows are the spine's."""
    return ma.label_balance(co.target_spine(event_log(spark, sf), C))


@register("flag_label_crosstab", MASTER_WITH + """
SELECT peer_flag, count(CASE WHEN target = 0 THEN 1 END) AS target_0, count(CASE WHEN target = 1 THEN 1 END) AS target_1
FROM master GROUP BY peer_flag""")
def q_flag_label_crosstab(spark, sf):
    """Peer flag x label contingency counts."""
    return sh.crosstab(written_master(spark, sf), "peer_flag", "target", [0, 1])


@register("rows_with_any_positive", MASTER_WITH + """
SELECT actor_id, cohort_month, target, org_flag, peer_flag, own_flag FROM master
WHERE org_flag > 0 OR peer_flag > 0 OR own_flag > 0""")
def q_rows_with_any_positive(spark, sf):
    """Master rows where any flag is positive."""
    m = written_master(spark, sf).select("actor_id", "cohort_month", "target", "org_flag", "peer_flag", "own_flag")
    return ma.rows_with_any_positive(m, ["org_flag", "peer_flag", "own_flag"])


@register("id_coverage", with_(EV, ACT, spine_cte()) + """
, ov AS (SELECT * FROM spine WHERE actor_id IN (SELECT actor_id FROM act))
SELECT count(DISTINCT actor_id) AS n_overlap_ids,
       count(DISTINCT CASE WHEN target = 1 THEN actor_id END) AS n_overlap_positive,
       count(DISTINCT CASE WHEN target = 0 THEN actor_id END) AS n_overlap_negative,
       min(cohort_month) AS first_month, max(cohort_month) AS last_month FROM ov""")
def q_id_coverage(spark, sf):
    """Spine actors that also appear in the activity log."""
    ev = event_log(spark, sf)
    return ma.id_coverage(co.target_spine(ev, C), activity_log(spark, sf))


_CH_FEATS = [c for _, _, c in fp._CH_COLS]


@register("feature_stats_monthly", with_(EV, fp.CHANNEL_SQL) + "\nSELECT cohort_month, count(*) AS n_rows, " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, "
    f"CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in _CH_FEATS) + " FROM chan GROUP BY cohort_month")
def q_feature_stats_monthly(spark, sf):
    """Per cohort month count, mean, stddev, min, max, sum of each channel feature."""
    return ma.feature_stats_monthly(fp.channel_df(spark, sf), "cohort_month", _CH_FEATS)


@register("new_actor_history", with_(EV, spine_cte()) + """
SELECT actor_id, subject_id, strftime(event_date, '%Y-%m-%d') AS event_date, month, product, quantity
FROM ev WHERE actor_id IN (SELECT actor_id FROM spine WHERE target = 1)""")
def q_new_actor_history(spark, sf):
    """Full history of the new (positive) actors."""
    ev = event_log(spark, sf)
    return ma.new_actor_history(ev, co.target_spine(ev, C)).select(
        "actor_id", "subject_id", "event_date", "month", "product", "quantity")
