"""Feature queries: shares, organisation and peer flags, specialty, ages,
characteristics, channel engagement, subject quantities, class breadth."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.config import TEST_CONFIG as C
from cohortkit.functions.dates import month_before
from cohortkit.operators import features as fe
from cohortkit.operators import shape as sh
from cohortkit.operators.panel import class_breadth_trailing
from cohortkit.operators.shape import col_name
from cohortkit.plans.oracle_sql import AFFL, CLASS_SQL, CLASSES, EV, PROFILE, with_
from cohortkit.plans.registry import register
from cohortkit.session import materialize
from cohortkit.sources.roles import actor_profile, affiliations, channel_log, event_log

T = C.target_product
NAMED, GROUPS = C.named_products, C.product_groups
EDGES = C.bucket_edges
# specialty rule parameters on the test tables (codes of the profile role)
SPEC_CODES = {"MACHINERY": "SPEC_MACHINERY", "HOUSEHOLD": "SPEC_HOUSEHOLD", "ASIA": "SPEC_ASIA",
              "1-URGENT": "SPEC_URGENT"}
SPEC_PARTS = ("AMER", "HIGH")
SPEC_FALLBACK = "SPEC_FALLBACK"
# the calendar year before the study: no event at or after a label month
_YEAR = int(C.study_start[:4]) - 1
AGE_YEAR = (f"{_YEAR}-01-01", f"{_YEAR}-12-31")
CHANNELS = {"click": "CLICK", "view": "VIEW", "purchase": "PURCHASE"}
CH_LO, CH_HI = "2024-01", "2024-12"
MEASURES = ("exposures", "light", "deep", "total")


def _mi(m: str) -> int:
    y, mm = m.split("-")
    return int(y) * 12 + int(mm) - 1


def _mstr(col: str) -> str:
    return f"printf('%04d-%02d', CAST(floor({col} / 12) AS INTEGER), CAST({col} % 12 + 1 AS INTEGER))"


def _mi_of(col: str) -> str:
    return f"(CAST(substr({col}, 1, 4) AS INTEGER) * 12 + CAST(substr({col}, 6, 2) AS INTEGER) - 1)"


def _in(vals) -> str:
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


def _bucket_sql(gap: str = "gap") -> str:
    out, lo = "CASE", 0
    for e in EDGES:
        out += f" WHEN {gap} > {lo} AND {gap} <= {e} THEN 'LAST_{e}M'"
        lo = e
    return out + " END"


def _fan_sql(name: str, src: str, cols: str, lag: int, lo: str, hi: str, horizon: int = 12) -> str:
    """CTE: rows of ``src`` fanned out to cohort indexes ci with gap in (0, horizon]."""
    return f"""
{name} AS (
  SELECT {cols}, ci, gap, {_bucket_sql()} AS bucket FROM (
    SELECT s.*, c.c AS ci, c.c - {lag} - {_mi_of('s.month')} AS gap
    FROM {src} s, (SELECT unnest(generate_series({_mi(lo)}, {_mi(hi)})) AS c) c
  ) x WHERE gap > 0 AND gap <= {horizon}
)"""


_GROUP_CASE = "CASE " + " ".join(f"WHEN product IN {_in(m)} THEN '{g}'" for g, m in GROUPS) + " END"
_ALL_GROUP = [p for _, m in GROUPS for p in m]
PU_SQL = f"""
base AS (
  SELECT DISTINCT actor_id, product,
         CASE WHEN use_flag IS NULL OR use_flag = 'UNK' THEN '1' ELSE use_flag END AS use, month, subject_id
  FROM ev WHERE product IS NOT NULL
),
pu AS (
  SELECT DISTINCT actor_id, month, product_use, subject_id FROM (
    SELECT actor_id, month, product || '_' || use AS product_use, subject_id FROM base WHERE product IN {_in(NAMED)}
    UNION ALL
    SELECT actor_id, month, {_GROUP_CASE} || '_' || use AS product_use, subject_id FROM base
    WHERE product IN {_in(_ALL_GROUP)}
  ) x
)""" + "," + _fan_sql("fan", "pu", "actor_id, product_use, subject_id", C.lag_months, C.study_start, C.study_end) + f""",
num AS (SELECT actor_id, ci, bucket, product_use, count(DISTINCT subject_id) AS n_subjects FROM fan GROUP BY 1, 2, 3, 4),
den AS (SELECT actor_id, ci, bucket, count(DISTINCT subject_id) AS row_total FROM fan GROUP BY 1, 2, 3),
shr AS (
  SELECT num.actor_id, num.ci, num.bucket, num.product_use, num.n_subjects, den.row_total,
         num.n_subjects * 1.0 / den.row_total AS share
  FROM num JOIN den ON num.actor_id = den.actor_id AND num.ci = den.ci AND num.bucket = den.bucket
)"""

_SHARE_VALS = [f"{pu}_LAST_{e}M" for pu in fe.product_use_values(NAMED, GROUPS) for e in EDGES]
_SHARE_COLS = [col_name("SHARE", v) for v in _SHARE_VALS]
SHARE_WIDE_SQL = PU_SQL + ",\nsw AS (SELECT actor_id, ci, " + ", ".join(
    f"max(CASE WHEN product_use || '_' || bucket = '{v}' THEN share END) AS {c}"
    for v, c in zip(_SHARE_VALS, _SHARE_COLS)) + f""" FROM shr GROUP BY actor_id, ci),
sgrid AS (SELECT a.actor_id, c.c AS ci FROM (SELECT DISTINCT actor_id FROM pu) a,
          (SELECT unnest(generate_series({_mi(C.study_start)}, {_mi(C.study_end)})) AS c) c),
swide AS (SELECT g.actor_id, {_mstr('g.ci')} AS cohort_month, """ + ", ".join(
    f"coalesce(sw.{c}, 0) AS {c}" for c in _SHARE_COLS) + """
  FROM sgrid g LEFT JOIN sw ON g.actor_id = sw.actor_id AND g.ci = sw.ci)"""


def _ev(spark, sf):
    return event_log(spark, sf)


def ev_informing(spark, sf, lag: int, horizon: int = 12):
    """Events of the months that can inform a cohort month of the study; the bounds reach the scan."""
    return event_log(spark, sf, f"{month_before(C.study_start, lag + horizon)}-01", C.study_end_date)


def actors(spark, sf):
    """Actors of the whole log: the rows of the dense tables."""
    return event_log(spark, sf).select("actor_id").distinct()



@register("share_by_product_use", with_(EV, PU_SQL) + f"""
SELECT actor_id, {_mstr('ci')} AS cohort_month, bucket, product_use, n_subjects, row_total, share FROM shr""")
def q_share_by_product_use(spark, sf):
    """D27 long: subject share per product x use and recency bucket (lag 2)."""
    return fe.share_by_product_use(ev_informing(spark, sf, C.lag_months), NAMED, GROUPS, C.study_start, C.study_end, C.lag_months, EDGES)


@register("share_wide", with_(EV, SHARE_WIDE_SQL) + "\nSELECT * FROM swide")
def q_share_wide(spark, sf):
    """D27 wide: dense actor x cohort month share features, 0-filled."""
    return fe.share_wide(ev_informing(spark, sf, C.lag_months), NAMED, GROUPS, C.study_start, C.study_end, C.lag_months,
                         EDGES, ids=fe.product_use_actors(_ev(spark, sf), NAMED, GROUPS))


_PU_VALS = fe.product_use_values(NAMED, GROUPS)


@register("subjects_by_product_use", with_(EV, PU_SQL) + "\nSELECT actor_id, month, " + ", ".join(
    f"count(DISTINCT CASE WHEN product_use = '{v}' THEN subject_id END) AS {col_name('N', v)}" for v in _PU_VALS)
    + " FROM pu GROUP BY actor_id, month")
def q_subjects_by_product_use(spark, sf):
    """Monthly distinct subjects per product x use, wide."""
    return fe.subjects_by_product_use(_ev(spark, sf), NAMED, GROUPS)


ORG_FLAG_SQL = "orgf AS (SELECT DISTINCT actor_id, month, 1 AS org_flag FROM ev WHERE institution IS NOT NULL)"


@register("org_flag", with_(EV, ORG_FLAG_SQL) + "\nSELECT actor_id, month, CAST(org_flag AS BIGINT) AS org_flag FROM orgf")
def q_org_flag(spark, sf):
    """Actor-months with an institution."""
    return fe.org_flag(_ev(spark, sf))


@register("org_size", with_(EV, AFFL) + """
SELECT CAST(org_id AS BIGINT) AS org_id, count(DISTINCT actor_id) AS account_size FROM affl WHERE org_rank = 1 GROUP BY org_id""")
def q_org_size(spark, sf):
    """Actors per organisation over main affiliations."""
    ev = _ev(spark, sf)
    return fe.org_size(affiliations(spark, sf, ev))


@register("org_degree", with_(EV, AFFL) + """
SELECT actor_id, count(DISTINCT org_id) AS n_orgs FROM affl GROUP BY actor_id""")
def q_org_degree(spark, sf):
    """Organisations per actor."""
    return fe.org_degree(affiliations(spark, sf, _ev(spark, sf)))


@register("org_members", with_(EV, AFFL) + """
SELECT CAST(org_id AS BIGINT) AS org_id, count(DISTINCT actor_id) AS n_actors FROM affl GROUP BY org_id""")
def q_org_members(spark, sf):
    """Actors per organisation over all affiliations."""
    return fe.org_members(affiliations(spark, sf, _ev(spark, sf)))


PEER_SQL = f"""
main AS (SELECT actor_id, org_id FROM affl WHERE org_rank = 1),
om AS (SELECT DISTINCT m.org_id, e.month FROM ev e JOIN main m ON e.actor_id = m.actor_id WHERE e.product = '{T}'),
""" + _fan_sql("ofan", "om", "org_id", C.lag_months, C.study_start, C.study_end).strip() + f""",
oc AS (SELECT DISTINCT org_id, ci FROM ofan),
peer AS (SELECT m.actor_id, {_mstr('oc.ci')} AS cohort_month, 1 AS peer_flag, m.org_id
         FROM oc JOIN main m ON oc.org_id = m.org_id)"""


@register("peer_use_flag", with_(EV, AFFL, PEER_SQL) + """
SELECT actor_id, cohort_month, CAST(peer_flag AS BIGINT) AS peer_flag, CAST(org_id AS BIGINT) AS org_id FROM peer""")
def q_peer_use_flag(spark, sf):
    """Actors whose main organisation had a target user in the 12 months before cohort - 2."""
    ev = ev_informing(spark, sf, C.lag_months)
    return fe.peer_use_flag(ev, affiliations(spark, sf), T, C.study_start, C.study_end, C.lag_months)


OWN_SQL = """
main_own AS (SELECT DISTINCT actor_id FROM affl WHERE org_rank = 1),
used AS (SELECT DISTINCT actor_id, month FROM ev WHERE product = '""" + T + """'),
""" + _fan_sql("ufan", "used", "actor_id", C.lag_months, C.study_start, C.study_end).strip() + f""",
hit AS (SELECT DISTINCT actor_id, ci FROM ufan),
own AS (
  SELECT m.actor_id, {_mstr('c.c')} AS cohort_month,
         CAST(CASE WHEN h.actor_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS own_flag
  FROM main_own m CROSS JOIN (SELECT unnest(generate_series({_mi(C.study_start)}, {_mi(C.study_end)})) AS c) c
  LEFT JOIN hit h ON h.actor_id = m.actor_id AND h.ci = c.c
)"""


@register("own_use_flag", with_(EV, AFFL, OWN_SQL) + "\nSELECT * FROM own")
def q_own_use_flag(spark, sf):
    """Per main-affiliated actor and cohort month, own target use in the 12 months before cohort - 2."""
    ev = ev_informing(spark, sf, C.lag_months)
    return fe.own_use_flag(ev, affiliations(spark, sf), T, C.study_start, C.study_end, C.lag_months)


def _spec_sql() -> str:
    codes = list(SPEC_CODES)
    first = "CASE " + " ".join(f"WHEN {c} IN {_in(codes)} THEN {c}" for c in ("c1", "c2", "c3")) + " END"
    grp = "CASE " + " ".join(f"WHEN fc = '{k}' THEN '{v}'" for k, v in SPEC_CODES.items()) + " END"
    fb = ("CASE WHEN " + " OR ".join(f"contains(c1 || '|' || c2 || '|' || c3, '{p}')" for p in SPEC_PARTS)
          + f" THEN '{SPEC_FALLBACK}' ELSE 'OTHERS' END")
    return f"""
spec AS (
  SELECT actor_id, coalesce({grp}, {fb}) AS specialty FROM (
    SELECT actor_id, c1, c2, c3, {first} AS fc FROM (
      SELECT actor_id, coalesce(code1, 'NA') AS c1, coalesce(code2, 'NA') AS c2, coalesce(code3, 'NA') AS c3
      FROM profile) a) b
)"""


@register("specialty_group", with_(PROFILE, _spec_sql()) + "\nSELECT actor_id, specialty FROM spec")
def q_specialty_group(spark, sf):
    """Specialty group from three codes (first accepted code, else substring rule)."""
    return fe.specialty_group(actor_profile(spark, sf), codes=SPEC_CODES, fallback_parts=SPEC_PARTS,
                              fallback_group=SPEC_FALLBACK)


_BANDS = [b[0] for b in fe.AGE_BANDS] + ["PAT_AGE_NA"]
AGE_SQL = f"""
aged AS (
  SELECT actor_id, subject_id,
         CAST(ceil(datediff('day', make_date(CAST(birth_year AS INTEGER), 1, 1), DATE '{C.as_of_date}') / 365.0) AS BIGINT) AS age
  FROM ev WHERE event_date >= DATE '{AGE_YEAR[0]}' AND event_date <= DATE '{AGE_YEAR[1]}'
),
banded AS (
  SELECT actor_id, subject_id,
         CASE WHEN age IS NULL THEN 'PAT_AGE_NA' WHEN age <= 11 THEN 'PAT_AGE_0_11'
              WHEN age >= 12 AND age <= 17 THEN 'PAT_AGE_12_17' WHEN age >= 18 AND age <= 24 THEN 'PAT_AGE_18_24'
              WHEN age >= 25 AND age <= 65 THEN 'PAT_AGE_25_65' WHEN age >= 66 THEN 'PAT_AGE_65+' END AS band
  FROM aged
),
ages AS (SELECT actor_id, """ + ", ".join(
    f'count(DISTINCT CASE WHEN band = \'{b}\' THEN subject_id END) AS "{b}_CNT"' for b in _BANDS) + """
  FROM banded GROUP BY actor_id)"""


@register("age_band_counts", with_(EV, AGE_SQL) + "\nSELECT * FROM ages")
def q_age_band_counts(spark, sf):
    """Distinct subjects per age band and actor in the reference year, wide."""
    return fe.age_band_counts(_ev(spark, sf), AGE_YEAR[0], AGE_YEAR[1], C.as_of_date)


CHAR_SQL = f"""
cnts AS (SELECT actor_id, count(DISTINCT subject_id) AS n_subjects FROM ev
         WHERE event_date >= DATE '{AGE_YEAR[0]}' AND event_date <= DATE '{AGE_YEAR[1]}' GROUP BY actor_id),
osize AS (SELECT org_id, count(DISTINCT actor_id) AS account_size FROM affl WHERE org_rank = 1 GROUP BY org_id),
chars AS (
  SELECT coalesce(c.actor_id, a.actor_id) AS actor_id, c.n_subjects, """ + ", ".join(
    f'a."{b}_CNT"' for b in _BANDS[:-1]) + """, s.specialty, CAST(m.org_id AS BIGINT) AS org_id, o.account_size
  FROM cnts c FULL OUTER JOIN ages a ON c.actor_id = a.actor_id
  LEFT JOIN spec s ON s.actor_id = coalesce(c.actor_id, a.actor_id)
  LEFT JOIN (SELECT actor_id, org_id FROM affl WHERE org_rank = 1) m ON m.actor_id = coalesce(c.actor_id, a.actor_id)
  LEFT JOIN osize o ON o.org_id = m.org_id
)"""


@register("actor_characteristics", with_(EV, AFFL, PROFILE, _spec_sql(), AGE_SQL, CHAR_SQL) + "\nSELECT * FROM chars")
def q_actor_characteristics(spark, sf):
    """Subject count ⟗ age bands ⟕ specialty ⟕ main org ⟕ org size."""
    ev = _ev(spark, sf)
    affl = affiliations(spark, sf, ev)
    return fe.actor_characteristics(
        fe.subject_counts(ev, *AGE_YEAR),
        fe.age_band_counts(ev, AGE_YEAR[0], AGE_YEAR[1], C.as_of_date),
        fe.specialty_group(actor_profile(spark, sf), codes=SPEC_CODES, fallback_parts=SPEC_PARTS,
                           fallback_group=SPEC_FALLBACK),
        affl, fe.org_size(affl))


MONTHLY_SQL = """
mf AS (
  SELECT coalesce(x.actor_id, p.actor_id) AS actor_id, coalesce(x.cohort_month, p.cohort_month) AS cohort_month,
         """ + ", ".join(f"x.{c}" for c in _SHARE_COLS) + """,
         coalesce(x.org_flag, 0) AS org_flag, CAST(coalesce(p.peer_flag, 0) AS BIGINT) AS peer_flag
  FROM (
    SELECT coalesce(s.actor_id, o.actor_id) AS actor_id, coalesce(s.cohort_month, o.month) AS cohort_month,
           """ + ", ".join(f"s.{c}" for c in _SHARE_COLS) + """, CAST(o.org_flag AS BIGINT) AS org_flag
    FROM swide s FULL OUTER JOIN orgf o ON s.actor_id = o.actor_id AND s.cohort_month = o.month
  ) x FULL OUTER JOIN peer p ON x.actor_id = p.actor_id AND x.cohort_month = p.cohort_month
)"""


def monthly_features_df(spark, sf):
    """The log is joined and written once; the shares travel as one map column and are laid out last."""
    ev = materialize(_ev(spark, sf).select("actor_id", "subject_id", "month", "product", "use_flag", "institution"), "event_log")
    affl = affiliations(spark, sf, ev)
    recent = ev.filter(F.col("month") >= month_before(C.study_start, C.lag_months + 12))
    shares = fe.share_map(recent, NAMED, GROUPS, C.study_start, C.study_end, C.lag_months, EDGES,
                          ids=fe.product_use_actors(ev, NAMED, GROUPS)).withColumn("_listed", F.lit(True))
    orgf = fe.org_flag(ev).withColumnRenamed("month", "cohort_month")
    peer = fe.peer_use_flag(recent, affl, T, C.study_start, C.study_end, C.lag_months).drop("org_id")
    keys = ["actor_id", "cohort_month"]
    both = shares.join(orgf, keys, "full").join(peer, keys, "full").fillna(0, ["org_flag", "peer_flag"])
    laid = zip(fe.share_columns(NAMED, GROUPS, EDGES), _SHARE_COLS)  # null where only a flag knows the key
    return both.select(*keys, *[F.when(F.col("_listed"), c).alias(n) for c, n in laid], "org_flag", "peer_flag")


@register("monthly_features", with_(EV, AFFL, SHARE_WIDE_SQL, ORG_FLAG_SQL, PEER_SQL, MONTHLY_SQL)
          + "\nSELECT * FROM mf")
def q_monthly_features(spark, sf):
    """Shares ⟗ institution flag ⟗ peer flag on (actor, cohort month); flags 0-filled."""
    return monthly_features_df(spark, sf)


_CH_VALS = [f"{c}_LAST_{e}M" for c in dict.fromkeys(CHANNELS.values()) for e in EDGES]
_CH_COLS = [(v, m, col_name(v, m)) for v in _CH_VALS for m in MEASURES]
_CH_CASE = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in CHANNELS.items()) + " END"
CHANNEL_SQL = f"""
known AS (SELECT DISTINCT CAST(actor_id AS VARCHAR) AS actor_key FROM ev),
cl AS (
  SELECT CAST(user_id AS VARCHAR) AS actor_key, strftime(ts, '%Y%m%d') AS date_key, event_type,
         1 AS exposures, CASE WHEN value < 50 THEN 1 ELSE 0 END AS light,
         CASE WHEN value >= 50 THEN 1 ELSE 0 END AS deep
  FROM events
),
chm AS (
  SELECT actor_key, strftime(strptime(date_key, '%Y%m%d'), '%Y-%m') AS month, {_CH_CASE} AS ch,
         sum(exposures) AS exposures, sum(light) AS light, sum(deep) AS deep, sum(light + deep) AS total
  FROM cl WHERE actor_key IS NOT NULL AND actor_key <> '-1' AND actor_key IN (SELECT actor_key FROM known)
    AND event_type IN {_in(CHANNELS)}
  GROUP BY 1, 2, 3
),
""" + _fan_sql("chf", "chm", "actor_key, ch, exposures, light, deep, total", 0, CH_LO, CH_HI).strip() + """,
chan AS (
  SELECT CAST(actor_key AS VARCHAR) AS actor_id, """ + _mstr("ci") + " AS cohort_month, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN ch || '_' || bucket = '{v}' THEN {m} END), 0) AS BIGINT) AS {c}"
    for v, m, c in _CH_COLS) + """
  FROM chf GROUP BY 1, 2
)"""


def channel_df(spark, sf):
    ev = _ev(spark, sf)
    return fe.channel_engagement(channel_log(spark, sf), ev.select("actor_id"), CHANNELS, CH_LO, CH_HI, 0,
                                 EDGES, MEASURES)


@register("channel_engagement", with_(EV, CHANNEL_SQL) + "\nSELECT * FROM chan")
def q_channel_engagement(spark, sf):
    """Channel engagement per actor and cohort month, wide by channel x bucket x measure."""
    return channel_df(spark, sf)


@register("subject_quantity_actor", with_(EV) + """
SELECT actor_id, subject_id, month, sum(quantity) AS quantity FROM ev GROUP BY actor_id, subject_id, month""")
def q_subject_quantity_actor(spark, sf):
    """D38 with the actor: quantity per actor, subject and month."""
    return fe.subject_quantity(_ev(spark, sf), ("actor_id", "subject_id"))


@register("subject_quantity", with_(EV) + """
SELECT subject_id, month, sum(quantity) AS quantity FROM ev GROUP BY subject_id, month""")
def q_subject_quantity(spark, sf):
    """Quantity per subject-month."""
    return fe.subject_quantity(_ev(spark, sf))


@register("subject_quantity_wide", with_(EV) + "\nSELECT subject_id, month, " + ", ".join(
    f"coalesce(sum(CASE WHEN product || '_' || (CASE WHEN use_flag = '0' THEN '0' ELSE '1' END) = '{p}_{u}' "
    f"THEN quantity END), 0) AS {col_name('QTY', f'{p}_{u}')}" for p in NAMED for u in ("0", "1"))
    + " FROM ev GROUP BY subject_id, month")
def q_subject_quantity_wide(spark, sf):
    """Quantity per subject-month by product x use, wide."""
    return fe.subject_quantity_wide(_ev(spark, sf), NAMED)


BREADTH_SQL = """
mon AS (SELECT actor_id, month, """ + CLASS_SQL + """ AS cls,
               count(DISTINCT coalesce(product, 'UNKNOWN')) AS n_items FROM ev GROUP BY 1, 2, 3),
""" + _fan_sql("bf", "mon", "actor_id, cls, n_items", 0, C.study_start, C.study_end).strip() + """,
bw AS (SELECT actor_id, ci, """ + ", ".join(
    f"sum(CASE WHEN cls = '{c}' THEN n_items END) AS N_{c}_12M" for c in CLASSES) + f""" FROM bf GROUP BY 1, 2),
breadth AS (
  SELECT a.actor_id, {_mstr('c.c')} AS cohort_month, """ + ", ".join(
    f"CAST(coalesce(bw.N_{c}_12M, 0) AS BIGINT) AS N_{c}_12M" for c in CLASSES) + f"""
  FROM (SELECT DISTINCT actor_id FROM ev) a
  CROSS JOIN (SELECT unnest(generate_series({_mi(C.study_start)}, {_mi(C.study_end)})) AS c) c
  LEFT JOIN bw ON bw.actor_id = a.actor_id AND bw.ci = c.c
)"""


@register("class_breadth_lookback", with_(EV, BREADTH_SQL) + "\nSELECT * FROM breadth")
def q_class_breadth_lookback(spark, sf):
    """Per class, sum of monthly distinct products with gap in (0, 12]."""
    return fe.class_breadth_lookback(ev_informing(spark, sf, 0), CLASSES, C.study_start, C.study_end, 0, 12,
                                     ids=actors(spark, sf))


_TS = [f"n_{c}_sum12" for c in CLASSES]


def _trailing_share_sql() -> str:
    from cohortkit.plans.registry import ORACLE

    base = ORACLE["class_breadth_trailing"]
    tot = " + ".join(f"coalesce({c}, 0)" for c in _TS)
    shares = ", ".join(f"CASE WHEN ({tot}) = 0 THEN NULL ELSE {c} * 1.0 / ({tot}) END AS {c}_share" for c in _TS)
    return f"SELECT t.*, {shares}, CAST({tot} AS BIGINT) AS row_total FROM ({base}) t"


import cohortkit.plans.panel_plans  # noqa: E402,F401  (registers class_breadth_trailing first)


@register("trailing_share", _trailing_share_sql())
def q_trailing_share(spark, sf):
    """Row total of the trailing class breadth and each class's share of it."""
    tr = class_breadth_trailing(_ev(spark, sf), CLASSES, C.first_month, C.study_end)
    return sh.with_row_total(sh.row_shares(tr, _TS), _TS, "row_total")
