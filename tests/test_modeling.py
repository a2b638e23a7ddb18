import random

import pytest
from pyspark.sql import functions as F

from cohortkit.modeling import explain as ex
from cohortkit.modeling import metrics as mt
from cohortkit.modeling import prep as pr


def brute(rows):
    pos = [s for l, s in rows if l == 1]
    neg = [s for l, s in rows if l == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    pts = [(0.0, 1.0)]
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for l, s in rows if l == 1 and s >= t)
        fp = sum(1 for l, s in rows if l == 0 and s >= t)
        pts.append((tp / len(pos), tp / (tp + fp)))
    pr_auc = sum((pts[i][0] - pts[i - 1][0]) * (pts[i][1] + pts[i - 1][1]) / 2 for i in range(1, len(pts)))
    return auc, pr_auc


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_and_pr_auc_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([0, 1]), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    m = mt.classification_metrics(df).first()
    auc, pra = brute(rows)
    assert abs(m["roc_auc"] - auc) < 1e-12 and abs(m["pr_auc"] - pra) < 1e-12


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert mt.roc_auc(df).first()[0] == 0.5
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert mt.roc_auc(one).first()[0] is None


def test_threshold_tie_first_wins(spark):
    # precision equal at 0.3 and 0.4 (both 2/3), lower elsewhere
    rows = [(1, 0.45), (1, 0.45), (0, 0.45), (0, 0.25), (0, 0.15), (1, 0.05)]
    df = spark.createDataFrame(rows, "label int, score double")
    sw = mt.threshold_sweep(df, (0.3, 0.4))
    assert mt.best_threshold(sw, "precision").first()["threshold"] == 0.3


def test_entity_confusion_counts_both_cells(spark):
    df = spark.createDataFrame([(7, 1, 0.9), (7, 1, 0.1)], "actor_id long, label int, score double")
    r = mt.entity_confusion(df, "actor_id").first()
    assert (r["tp"], r["fn"]) == (1, 1)


def test_reasons_keep_sign(spark):
    df = spark.createDataFrame([(1, -3.0, 2.0, 1.0)], "id long, attr_a double, attr_b double, attr_c double")
    r = ex.top_reasons(df, ["a", "b", "c"], ["id"], 2).first()
    assert (r["reason_1"], r["reason_1_value"], r["reason_2"]) == ("a", -3.0, "b")


def test_split_edge_in_train(spark):
    df = spark.createDataFrame([("2001-03",), ("2001-04",)], "m string")
    tr, te = pr.temporal_split(df, "m", "2001-03")
    assert [r[0] for r in tr.collect()] == ["2001-03"] and [r[0] for r in te.collect()] == ["2001-04"]


def test_resampling_sizes_and_determinism(spark):
    df = spark.createDataFrame([(i, "m", 1 if i < 7 else 0) for i in range(30)], "id long, k string, y int")
    u = pr.undersample(df, "y", ["id", "k"], 42)
    assert sorted(r["y"] for r in u.collect()) == [0] * 7 + [1] * 7
    assert sorted(u.collect()) == sorted(pr.undersample(df, "y", ["id", "k"], 42).collect())
    o = pr.oversample(df, "y", ["id", "k"], 42)
    cnt = {r["y"]: r["count"] for r in o.groupBy("y").count().collect()}
    assert cnt == {0: 23, 1: 23}


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    st = pr.fit_scaler(df, ["x"])
    got = sorted(r[0] for r in pr.apply_scaler(df, st, ["x"]).collect())
    assert got == [-1.0, 1.0]


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = {r["y"]: r["weight"] for r in pr.class_weights(df, "y").collect()}
    assert w == {1: 2.0, 0: 4 / 6}
