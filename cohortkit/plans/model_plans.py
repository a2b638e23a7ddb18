"""Modelling queries.

Metric queries score the spine with a fixed formula of actor id and month
(FIXTURES.md §C) so that their values can be checked against SQL; queries
that fit models are checked on rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.config import TEST_CONFIG as C
from cohortkit.functions.dates import month_index_of_str
from cohortkit.modeling import explain as ex
from cohortkit.modeling import metrics as mt
from cohortkit.modeling import models as md
from cohortkit.modeling import prep as pr
from cohortkit.modeling.versions import PRODUCTION, ModelVersions
from cohortkit.operators import cohort as co
from cohortkit.operators import features as fe
from cohortkit.plans import feature_plans as fp
from cohortkit.plans.cohort_plans import _ev_spine, spine_cte
from cohortkit.plans.master_plans import written_master
from cohortkit.plans.oracle_sql import EV, with_
from cohortkit.plans.registry import register
from cohortkit.session import materialize, shared_path
from cohortkit.sources.roles import event_log

KEYS = ["actor_id", "cohort_month"]
BREADTH = [f"N_{c}_12M" for c in fp.CLASSES]
# Fixed coefficients for the attribution queries (so SQL can check them).
FIXED_COEFS = dict(zip(BREADTH, (0.5, -0.25, 0.1, -0.4, 0.3, 0.05, 0.2, -0.15)))
FIXED_THRESHOLDS = (0.95, 0.72, 0.75, 0.23, 0.215)
BINARY = ("org_flag", "peer_flag", "own_flag")
SEED = C.seed


def _spine(spark, sf):
    return co.target_spine(_ev_spine(spark, sf), C)


def scored_fixture(spark, sf):
    """Spine with score = ((actor_id * 31 + month_index * 17) % 1000) / 1000 and label = target."""
    s = _spine(spark, sf)
    mi = month_index_of_str("cohort_month")
    return s.select("actor_id", "cohort_month", F.col("target").alias("label"),
                    (((F.col("actor_id") * 31 + mi * 17) % 1000).cast("double") / 1000.0).alias("score"))


SCORED_SQL = spine_cte() + """,
scored AS (
  SELECT actor_id, cohort_month, target AS label,
         CAST((actor_id * 31 + (CAST(substr(cohort_month, 1, 4) AS BIGINT) * 12
               + CAST(substr(cohort_month, 6, 2) AS BIGINT) - 1) * 17) % 1000 AS DOUBLE) / 1000.0 AS score
  FROM spine
)"""
SW = with_(EV, SCORED_SQL)

CM_SQL = """
cm AS (
  SELECT CAST(count(CASE WHEN score < {t} AND label <> 1 THEN 1 END) AS BIGINT) AS tn,
         CAST(count(CASE WHEN score >= {t} AND label <> 1 THEN 1 END) AS BIGINT) AS fp,
         CAST(count(CASE WHEN score < {t} AND label = 1 THEN 1 END) AS BIGINT) AS fn,
         CAST(count(CASE WHEN score >= {t} AND label = 1 THEN 1 END) AS BIGINT) AS tp
  FROM scored
)"""
RATES = """
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS recall,
  CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tp = 0 THEN 0.0
       ELSE 2.0 * (tp * 1.0 / (tp + fp)) * (tp * 1.0 / (tp + fn)) / ((tp * 1.0 / (tp + fp)) + (tp * 1.0 / (tp + fn))) END AS f1,
  CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) * 1.0 / (tp + tn + fp + fn) END AS accuracy"""
AUC_SQL = """
pn AS (SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS P,
              CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS N FROM scored),
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
auc AS (SELECT CASE WHEN P > 0 AND N > 0 THEN
          ((SELECT sum(r) FROM rk WHERE label = 1) - P * (P + 1) / 2) / (P * N) END AS roc_auc FROM pn),
g AS (SELECT score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS npos,
             CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS nneg FROM scored GROUP BY score),
cu AS (SELECT *, sum(npos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
              sum(nneg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM g),
prc AS (SELECT CASE WHEN sum(npos) > 0 THEN sum(npos * (ctp / (ctp + cfp)
          + CASE WHEN ctp - npos + cfp - nneg = 0 THEN 1.0 ELSE (ctp - npos) / (ctp - npos + cfp - nneg) END) / 2)
          / sum(npos) END AS pr_auc,
               CASE WHEN sum(npos) > 0 THEN sum(npos * ctp / (ctp + cfp)) / sum(npos) END AS average_precision
        FROM cu)"""


@register("temporal_split", with_(EV, spine_cte()) + f"""
SELECT actor_id, cohort_month, CAST(target AS BIGINT) AS target,
       CASE WHEN cohort_month <= '{C.train_end}' THEN 'train' ELSE 'test' END AS split FROM spine""")
def q_temporal_split(spark, sf):
    """M1: train up to and including the train-end month, test after."""
    return pr.with_split(_spine(spark, sf), "cohort_month", C.train_end)


def _spine_breadth(spark, sf):
    """The spine with its breadth, written: a fit of the training rows and the rows themselves both read it."""
    spine = materialize(_spine(spark, sf), "spine")
    recent = fp.ev_informing(spark, sf, 0).join(spine.select("actor_id").distinct(), "actor_id", "left_semi")
    br = fe.class_breadth_lookback(recent, fp.CLASSES, C.study_start, C.study_end, 0, 12, dense=False)
    return materialize(spine.join(br, KEYS, "left").fillna(0, BREADTH), "spine_breadth")


SB_SQL = fp.BREADTH_SQL.strip() + """,
sb AS (SELECT sp.actor_id, sp.cohort_month, sp.target, """ + ", ".join(
    f"CAST(coalesce(b.{c}, 0) AS DOUBLE) AS {c}" for c in BREADTH) + """
       FROM spine sp LEFT JOIN breadth b ON b.actor_id = sp.actor_id AND b.cohort_month = sp.cohort_month)"""


@register("standard_scale", with_(EV, spine_cte(), SB_SQL) + """
, st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in BREADTH)
          + f""" FROM sb WHERE cohort_month <= '{C.train_end}')
SELECT sb.actor_id, sb.cohort_month, CAST(sb.target AS BIGINT) AS target, """ + ", ".join(
    f"CASE WHEN st.s_{c} = 0 THEN NULL ELSE (sb.{c} - st.m_{c}) / st.s_{c} END AS {c}" for c in BREADTH)
          + " FROM sb, st")
def q_standard_scale(spark, sf):
    """M2: standardise with train-month mean and population stddev, applied to all rows."""
    df = _spine_breadth(spark, sf).select(*KEYS, "target", *[F.col(c).cast("double").alias(c) for c in BREADTH])
    train, _ = pr.temporal_split(df, "cohort_month", C.train_end)
    return pr.apply_scaler(df, pr.fit_scaler(train, BREADTH), BREADTH)


@register("class_weights", with_(EV, spine_cte()) + """
SELECT CAST(target AS BIGINT) AS target, count(*) AS n,
       (SELECT count(*) FROM spine) * 1.0 / ((SELECT count(DISTINCT target) FROM spine) * count(*)) AS weight
FROM spine GROUP BY target""")
def q_class_weights(spark, sf):
    """M5: balanced class weights n / (k * n_class)."""
    return pr.class_weights(_spine(spark, sf), "target")


HASH_SQL = f"""
hs AS (SELECT *, md5(CAST(actor_id AS VARCHAR) || '|' || cohort_month || '|' || '{SEED}') AS h FROM spine),
cc AS (SELECT target, count(*) AS n FROM spine GROUP BY target)"""


@register("undersample", with_(EV, spine_cte(), HASH_SQL) + """
SELECT actor_id, cohort_month, CAST(target AS BIGINT) AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY h, actor_id, cohort_month) AS r FROM hs) x
WHERE r <= (SELECT min(n) FROM cc)""")
def q_undersample(spark, sf):
    """M4: every class cut to the minority size by seeded hash order."""
    return pr.undersample(_spine(spark, sf), "target", KEYS, SEED)


@register("oversample", with_(EV, spine_cte(), HASH_SQL) + """
, par AS (SELECT target, n, ((SELECT max(n) FROM cc) - n) // n AS k, ((SELECT max(n) FROM cc) - n) % n AS rem FROM cc),
ranked AS (SELECT hs.*, row_number() OVER (PARTITION BY hs.target ORDER BY h, actor_id, cohort_month) AS r FROM hs)
SELECT r.actor_id, r.cohort_month, CAST(r.target AS BIGINT) AS target, CAST(c.copy AS BIGINT) AS copy
FROM ranked r JOIN par p ON r.target = p.target, (SELECT unnest(generate_series(0, 100000)) AS copy) c
WHERE c.copy <= p.k
UNION ALL
SELECT r.actor_id, r.cohort_month, CAST(r.target AS BIGINT), CAST(p.k + 1 AS BIGINT)
FROM ranked r JOIN par p ON r.target = p.target WHERE r.r <= p.rem""")
def q_oversample(spark, sf):
    """M3: every class grown to the majority size (whole copies + hash-ordered remainder)."""
    return pr.oversample(_spine(spark, sf), "target", KEYS, SEED)


@register("classification_metrics", with_(EV, SCORED_SQL, CM_SQL.format(t=0.5), AUC_SQL) + f"""
SELECT 0.5 AS threshold, tn, fp, fn, tp, {RATES},
       (SELECT roc_auc FROM auc) AS roc_auc, (SELECT pr_auc FROM prc) AS pr_auc FROM cm""")
def q_classification_metrics(spark, sf):
    """ROC-AUC (tie-averaged), PR-AUC (trapezoid), confusion counts and rates at 0.5."""
    return mt.classification_metrics(scored_fixture(spark, sf))


def _report_sql():
    per = f"""
per AS (
  SELECT '0' AS class, CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn * 1.0 / (tn + fn) END AS precision,
         CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn * 1.0 / (tn + fp) END AS recall, tn + fp AS support FROM cm
  UNION ALL
  SELECT '1', CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END, tp + fn FROM cm
),
per2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
         FROM per)"""
    return with_(EV, SCORED_SQL, CM_SQL.format(t=0.5), per) + """
SELECT class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2"""


@register("classification_report", _report_sql())
def q_classification_report(spark, sf):
    """Per-class precision, recall, f1, support and their averages."""
    return mt.classification_report(scored_fixture(spark, sf))


@register("pr_curve", with_(EV, SCORED_SQL) + """
, g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS npos,
               sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS nneg FROM scored GROUP BY score),
cu AS (SELECT *, sum(npos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
              sum(nneg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM g)
SELECT score AS threshold, ctp * 1.0 / (ctp + cfp) AS precision,
       ctp * 1.0 / (SELECT sum(npos) FROM g) AS recall FROM cu""")
def q_pr_curve(spark, sf):
    """Precision and recall at every distinct score."""
    return mt.pr_curve(scored_fixture(spark, sf))


@register("average_precision", with_(EV, SCORED_SQL, AUC_SQL) + "\nSELECT average_precision FROM prc")
def q_average_precision(spark, sf):
    """Average precision."""
    return mt.average_precision(scored_fixture(spark, sf))


def _sweep_sql(ths):
    parts = []
    for t in ths:
        parts.append(f"""SELECT CAST({t} AS DOUBLE) AS threshold,
  CAST(count(CASE WHEN score < {t} AND label <> 1 THEN 1 END) AS BIGINT) AS tn,
  CAST(count(CASE WHEN score >= {t} AND label <> 1 THEN 1 END) AS BIGINT) AS fp,
  CAST(count(CASE WHEN score < {t} AND label = 1 THEN 1 END) AS BIGINT) AS fn,
  CAST(count(CASE WHEN score >= {t} AND label = 1 THEN 1 END) AS BIGINT) AS tp FROM scored""")
    return "sw AS (" + "\nUNION ALL ".join(parts) + f"),\nswr AS (SELECT threshold, tn, fp, fn, tp, {RATES} FROM sw)"


@register("threshold_sweep", with_(EV, SCORED_SQL, _sweep_sql(mt.THRESHOLDS)) + "\nSELECT * FROM swr")
def q_threshold_sweep(spark, sf):
    """Confusion counts and rates at thresholds 0.1 .. 0.9."""
    return mt.threshold_sweep(scored_fixture(spark, sf))


@register("fixed_threshold_metrics", with_(EV, SCORED_SQL, _sweep_sql(FIXED_THRESHOLDS)) + "\nSELECT * FROM swr")
def q_fixed_threshold_metrics(spark, sf):
    """Rates at the fixed thresholds used by the reference."""
    return mt.threshold_sweep(scored_fixture(spark, sf), FIXED_THRESHOLDS)


@register("best_threshold", with_(EV, SCORED_SQL, _sweep_sql(mt.THRESHOLDS)) + """
SELECT m.metric, CASE WHEN m.v > 0 THEN m.t ELSE 0.5 END AS threshold, m.v AS value FROM (
  SELECT 'precision' AS metric, (SELECT min(threshold) FROM swr WHERE precision = (SELECT max(precision) FROM swr)) AS t,
         (SELECT max(precision) FROM swr) AS v
  UNION ALL
  SELECT 'recall', (SELECT min(threshold) FROM swr WHERE recall = (SELECT max(recall) FROM swr)),
         (SELECT max(recall) FROM swr)) m""")
def q_best_threshold(spark, sf):
    """First threshold with the best precision and with the best recall."""
    sw = mt.threshold_sweep(scored_fixture(spark, sf))
    return mt.best_threshold(sw, "precision").unionByName(mt.best_threshold(sw, "recall"))


@register("entity_confusion", with_(EV, SCORED_SQL) + f"""
, ec AS (SELECT count(DISTINCT CASE WHEN score < 0.5 AND label <> 1 THEN actor_id END) AS tn,
                count(DISTINCT CASE WHEN score >= 0.5 AND label <> 1 THEN actor_id END) AS fp,
                count(DISTINCT CASE WHEN score < 0.5 AND label = 1 THEN actor_id END) AS fn,
                count(DISTINCT CASE WHEN score >= 0.5 AND label = 1 THEN actor_id END) AS tp FROM scored)
SELECT tn, fp, fn, tp, {RATES}, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn * 1.0 / (tn + fp) END AS specificity FROM ec""")
def q_entity_confusion(spark, sf):
    """Distinct actors per confusion cell and rates on them."""
    return mt.entity_confusion(scored_fixture(spark, sf), "actor_id")


@register("score_histogram", with_(EV, SCORED_SQL) + """
, h AS (SELECT label, CAST(least(greatest(floor(score * 50), 0), 49) AS INTEGER) AS bin, count(*) AS n
        FROM scored GROUP BY 1, 2),
hst AS (SELECT label, avg(score) AS mean, stddev_samp(score) AS std FROM scored GROUP BY label)
SELECT CAST(h.label AS BIGINT) AS label, CAST(h.bin AS BIGINT) AS bin, h.bin / 50.0 AS bin_start, h.n, hst.mean, hst.std
FROM h JOIN hst ON h.label = hst.label""")
def q_score_histogram(spark, sf):
    """50-bin score histogram, mean and stddev per true class."""
    return mt.score_histogram(scored_fixture(spark, sf))


def _attr_df(spark, sf):
    df = _spine_breadth(spark, sf).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in BREADTH])
    train, _ = pr.temporal_split(df, "cohort_month", C.train_end)
    means = train.agg(*[F.avg(c).alias(c) for c in BREADTH]).first().asDict()  # one row
    return ex.linear_attributions(df, FIXED_COEFS, means, KEYS)


ATTR_SQL = SB_SQL + """,
mn AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}" for c in BREADTH) + f""" FROM sb WHERE cohort_month <= '{C.train_end}'),
attr AS (SELECT sb.actor_id, sb.cohort_month, """ + ", ".join(
    f"CAST({FIXED_COEFS[c]} AS DOUBLE) * (sb.{c} - mn.m_{c}) AS attr_{c}" for c in BREADTH) + " FROM sb, mn)"


@register("linear_attributions", with_(EV, spine_cte(), ATTR_SQL) + "\nSELECT * FROM attr")
def q_linear_attributions(spark, sf):
    """Coef * (x - training mean) per feature with fixed coefficients."""
    return _attr_df(spark, sf)


def _reasons_sql():
    long = "\n  UNION ALL ".join(f"SELECT actor_id, cohort_month, '{c}' AS name, attr_{c} AS v FROM attr" for c in BREADTH)
    return f"""
, lg AS ({long}),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY actor_id, cohort_month ORDER BY abs(v) DESC, name) AS r FROM lg)
SELECT actor_id, cohort_month, """ + ", ".join(
        f"max(CASE WHEN r = {i} THEN name END) AS reason_{i}, max(CASE WHEN r = {i} THEN v END) AS reason_{i}_value"
        for i in (1, 2, 3)) + " FROM rk2 GROUP BY actor_id, cohort_month"


@register("top_reasons", with_(EV, spine_cte(), ATTR_SQL) + _reasons_sql())
def q_top_reasons(spark, sf):
    """Three largest |attributions| per row with their signed values."""
    return ex.top_reasons(_attr_df(spark, sf), BREADTH, KEYS, 3)


@register("temporal_cv_splits", with_(EV, spine_cte()) + """
, mo AS (SELECT cohort_month, dense_rank() OVER (ORDER BY cohort_month) - 1 AS i FROM (SELECT DISTINCT cohort_month FROM spine) x),
sz AS (SELECT count(*) AS m, greatest(count(*) // 8, 1) AS size FROM mo),
fo AS (SELECT unnest(generate_series(1, 7)) AS fold),
ro AS (SELECT fo.fold, mo.cohort_month,
              CASE WHEN mo.i < sz.m - (8 - fo.fold) * sz.size THEN 'train'
                   WHEN mo.i < sz.m - (7 - fo.fold) * sz.size THEN 'valid' END AS role
       FROM mo, fo, sz),
pm AS (SELECT cohort_month, count(*) AS n FROM spine GROUP BY cohort_month)
SELECT ro.fold, CAST(sum(CASE WHEN role = 'train' THEN n END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN role = 'valid' THEN n END) AS BIGINT) AS n_valid,
       min(CASE WHEN role = 'train' THEN ro.cohort_month END) AS train_from,
       max(CASE WHEN role = 'train' THEN ro.cohort_month END) AS train_to,
       min(CASE WHEN role = 'valid' THEN ro.cohort_month END) AS valid_from,
       max(CASE WHEN role = 'valid' THEN ro.cohort_month END) AS valid_to
FROM ro JOIN pm ON ro.cohort_month = pm.cohort_month WHERE role IS NOT NULL GROUP BY ro.fold""")
def q_temporal_cv_splits(spark, sf):
    """7 expanding month-ordered folds with their sizes and month ranges."""
    return pr.expanding_month_splits(_spine(spark, sf), "cohort_month", 7)


# ---- fitted models (rows-only checks) ---------------------------------------------------------

def scaled_master(spark, sf):
    """The run's master table, numeric features scaled with train statistics; its features, and those that are 0 in every row."""
    m = written_master(spark, sf)
    feats = [c for c, t in m.dtypes if c not in ("actor_id", "cohort_month", "target", "org_id")
             and t in ("int", "bigint", "double")]
    m = m.select(*KEYS, "target", *[F.col(c).cast("double").alias(c) for c in feats])
    train, _ = pr.temporal_split(m, "cohort_month", C.train_end)
    scaled = [c for c in feats if c not in BINARY]
    stats = pr.fit_scaler(train, scaled)
    row = stats.first()
    whole = pr.apply_scaler(m, spark.createDataFrame([row], stats.schema), scaled).fillna(0.0)
    return whole, feats, [c for c in scaled if not row[f"{c}__std"]]  # divided by no deviation: null, then 0


def model_frame(spark, sf):
    """Scaled rows of the train months and of the later ones, and their features."""
    whole, feats, _ = scaled_master(spark, sf)
    return *pr.temporal_split(whole, "cohort_month", C.train_end), feats


def model_matrix(spark, sf, written: bool = True, zeros: bool = True):
    """All rows as one matrix, written unless its reader does so, with the train months' condition.

    Without ``zeros`` it has no features that are 0 in every row.
    """
    whole, feats, flat = scaled_master(spark, sf)
    train, test = pr.temporal_split(whole, "cohort_month", C.train_end)
    kept = feats if zeros else [f for f in feats if f not in set(flat)] or feats
    return md.Matrix.of(train.unionByName(test), kept, [*KEYS, "target"], written), F.col("cohort_month") <= C.train_end


def _fit_score(spark, sf, kind):
    train, test, feats = model_frame(spark, sf)
    weighted = pr.with_positive_weight(train, "target") if kind == "boosted" else pr.with_class_weight(train, "target")
    model = md.fit(weighted, feats, kind, weight_col="weight", seed=SEED)
    return md.score(model, test).select(*KEYS, "target", "score", "prediction")


@register("logistic_scores")
def q_logistic_scores(spark, sf):
    """M6: class-weighted L1 logistic regression, scored on the held-out months."""
    return _fit_score(spark, sf, "logistic_l1")


@register("forest_scores")
def q_forest_scores(spark, sf):
    """M7: random forest (100 trees)."""
    return _fit_score(spark, sf, "forest")


@register("boosted_scores")
def q_boosted_scores(spark, sf):
    """M8: gradient-boosted trees with class weights."""
    return _fit_score(spark, sf, "boosted")


@register("mlp_scores")
def q_mlp_scores(spark, sf):
    """M9: 50-25-5 feed-forward network."""
    return _fit_score(spark, sf, "mlp")


@register("select_features")
def q_select_features(spark, sf):
    """Forest importances above their mean, at most 50."""
    train, _, feats = model_frame(spark, sf)
    model = md.fit(train, feats, "forest", seed=SEED)
    chosen = md.select_by_importance(model, feats, 50)
    imp = dict(zip(feats, md.last_stage(model).featureImportances.toArray()))
    return spark.createDataFrame([(f, float(imp[f]), i + 1) for i, f in enumerate(chosen)],
                                 "feature string, importance double, rank int")


@register("recursive_elimination")
def q_recursive_elimination(spark, sf):
    """L2 logistic models refitted on ever fewer features, ten dropped a round, until 50 remain (round 0)."""
    matrix, is_train = model_matrix(spark, sf)
    rows = md.recursive_elimination(matrix.where(is_train), keep=50, step=10, max_iter=100)
    return spark.createDataFrame(rows, "round int, feature string, abs_coef double")


@register("coefficient_rank")
def q_coefficient_rank(spark, sf):
    """Top-20 logistic coefficients by absolute value."""
    train, _, feats = model_frame(spark, sf)
    model = md.fit(pr.with_class_weight(train, "target"), feats, "logistic_l1", weight_col="weight")
    tab = ex.coefficient_table(spark, feats, md.last_stage(model).coefficients.toArray())
    return ex.coefficient_rank(tab, 20)


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Forest feature importances."""
    train, _, feats = model_frame(spark, sf)
    model = md.fit(train, feats, "forest", seed=SEED)
    return ex.feature_importance_table(spark, feats, md.last_stage(model).featureImportances.toArray())


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """Accuracy the network loses when a feature is permuted, five times each."""
    matrix, is_train = model_matrix(spark, sf)
    network = matrix.where(is_train).fit("mlp", seed=SEED)
    layers, weights = list(network.getLayers()), network.weights.toArray()
    return ex.permutation_importance(lambda x: ex.forward(layers, weights, x).argmax(axis=1), matrix.where(~is_train), KEYS,
                                     "target", 5, SEED)


LEARNING_FRACTIONS = tuple(k / 10 for k in range(1, 11))


@register("learning_curve")
def q_learning_curve(spark, sf):
    """Train / validation accuracy at ten nested sizes over seven expanding folds, mean and deviation."""
    # the curve writes the rows by its own steps; a logistic model's coefficient of zeros is 0
    matrix, _ = model_matrix(spark, sf, written=False, zeros=False)
    folds = pr.expanding_month_splits(matrix.rows, "cohort_month", 7)
    curve = md.learning_curve(matrix, folds, LEARNING_FRACTIONS, "target", seed=SEED, max_iter=20)
    return md.learning_curve_summary(curve)


#: Every kind as it is, and the linear and tree models behind selection and resampling.
COMPARED = tuple((kind, "none", "weights") for kind in ("logistic_l1", "forest", "boosted", "mlp")) + tuple(
    (kind, "importance", how) for kind in ("logistic_l1", "forest") for how in ("oversample", "undersample"))


@register("model_comparison")
def q_model_comparison(spark, sf):
    """Select and resample on the train months, fit each kind, judge on the untouched later months."""
    matrix, is_train = model_matrix(spark, sf)
    out = None
    for row in md.compare_models(matrix.where(is_train), matrix.where(~is_train), COMPARED, "target", KEYS, SEED):
        row = materialize(row, "metrics")  # one row for each setting, written once
        out = row if out is None else out.unionByName(row)
    return out


@register("model_versions")
def q_model_versions(spark, sf):
    """Save two versions, promote them one after the other, list them and judge the latest production version."""
    train, test, feats = model_frame(spark, sf)
    versions = ModelVersions(spark, shared_path(spark, "models", "versions"))
    weighted = pr.with_class_weight(train, "target")
    for kind in ("logistic_l2", "logistic_l1"):
        version = versions.save(md.fit(weighted, feats, kind, weight_col="weight", max_iter=100), "propensity", {"kind": kind})
        versions.promote("propensity", version)
    scored = md.score(versions.load("propensity"), test).select(F.col("target").alias("label"), "score")
    auc = mt.roc_auc(scored).scalar()
    return versions.list("propensity").select("name", "version", "stage", "metrics",
                                              F.when(F.col("stage") == PRODUCTION, auc).alias("roc_auc"))


@register("score_batch")
def q_score_batch(spark, sf):
    """Probability and label for every master row with a model fitted on the train months."""
    train, test, feats = model_frame(spark, sf)
    model = md.fit(pr.with_class_weight(train, "target"), feats, "logistic_l1", weight_col="weight")
    return md.score(model, train.unionByName(test)).select(*KEYS, "target", "score", "prediction")
