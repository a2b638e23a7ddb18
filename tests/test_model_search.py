"""Elimination, learning curve, permutation importance, comparison and versions."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortkit.modeling import explain as ex
from cohortkit.modeling import models as md
from cohortkit.modeling import prep as pr
from cohortkit.modeling.versions import ARCHIVED, PRODUCTION, ModelVersions

FEATURES = [f"f{i}" for i in range(6)]
KEYS = ["actor_id", "cohort_month"]


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        x = [rnd.gauss(0, 1) for _ in FEATURES]
        target = int(2 * x[0] - 1.2 * x[1] + 0.5 * x[2] + rnd.gauss(0, 0.7) > 1)
        rows.append((i, f"2001-{1 + i % 9:02d}", target, *x))
    return spark.createDataFrame(rows, "actor_id long, cohort_month string, target int, " + ", ".join(f"{f} double" for f in FEATURES))


@pytest.fixture(scope="module")
def matrix(frame):
    return md.Matrix.of(frame, FEATURES, [*KEYS, "target"])


def test_elimination_drops_the_smallest_coefficients_of_a_refit(frame, matrix):
    rows = md.recursive_elimination(matrix, keep=2, step=1, max_iter=100)
    assert [n for n, _, _ in rows] == [1, 2, 3, 4, 0, 0]
    left = list(FEATURES)
    for n, feature, size in rows[:4]:
        refit = md.last_stage(md.fit(frame, left, "logistic_l2", max_iter=100)).coefficients.toArray()
        smallest = min(zip(np.abs(refit), left))
        assert feature == smallest[1] and abs(size - smallest[0]) < 1e-6
        left.remove(feature)
    assert {f for n, f, _ in rows if n == 0} == set(left) == {"f0", "f1"}
    by_twos = md.recursive_elimination(matrix, keep=3, step=2, max_iter=100)
    assert [n for n, _, _ in by_twos] == [1, 1, 2, 0, 0, 0]
    with pytest.raises(ValueError):
        md.recursive_elimination(matrix, keep=2, step=0)


def test_sliced_matrix_keeps_the_columns(matrix):
    rows = matrix.sliced(["f4", "f1"]).rows.select("actor_id", vector_to_array("features").alias("x")).orderBy("actor_id").limit(5).collect()
    whole = matrix.rows.select("actor_id", vector_to_array("features").alias("x")).orderBy("actor_id").limit(5).collect()
    assert [r["x"] for r in rows] == [[r["x"][4], r["x"][1]] for r in whole]


def test_learning_curve_sizes_are_nested_and_folds_expand(spark, frame, matrix):
    folds = pr.expanding_month_splits(frame, "cohort_month", 2)
    fractions = (0.3, 0.6, 1.0)
    curve = md.learning_curve(matrix, folds, fractions, seed=3, max_iter=30)
    rows = {(r["fold"], r["fraction"]): r for r in curve.collect()}
    assert set(rows) == {(k, f) for k in (1, 2) for f in fractions}
    for f in folds.collect():
        train = frame.where(F.col("cohort_month") <= f["train_to"])
        members = [{tuple(r) for r in train.where(md.prefix_place(KEYS, 3) < x).select(*KEYS).collect()} for x in fractions]
        assert members[0] < members[1] < members[2] and len(members[2]) == f["n_train"]
        for x, m in zip(fractions, members):
            r = rows[f["fold"], x]
            assert (r["n_train"], r["n_valid"]) == (len(m), f["n_valid"])
    # one point again, by hand
    fold = folds.where("fold = 2").first()
    part = frame.where((F.col("cohort_month") <= fold["train_to"]) & (md.prefix_place(KEYS, 3) < 0.6))
    model = md.fit(part, FEATURES, "logistic_l2", max_iter=30)
    valid = frame.where((F.col("cohort_month") >= fold["valid_from"]) & (F.col("cohort_month") <= fold["valid_to"]))
    right = [r["target"] == r["prediction"] for r in md.score(model, valid).collect()]
    assert abs(rows[2, 0.6]["valid_accuracy"] - np.mean(right)) < 1e-9
    summary = {r["fraction"]: r for r in md.learning_curve_summary(curve).collect()}
    for x in fractions:
        values = [rows[k, x]["valid_accuracy"] for k in (1, 2)]
        assert abs(summary[x]["valid_accuracy_mean"] - np.mean(values)) < 1e-12
        assert abs(summary[x]["valid_accuracy_std"] - np.std(values, ddof=1)) < 1e-12


def test_forward_equals_the_network(matrix):
    network = matrix.fit("mlp", seed=2)
    rows = network.transform(matrix.rows).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    got = ex.forward(list(network.getLayers()), network.weights.toArray(), np.array([r["x"] for r in rows]))
    assert np.allclose(got, [r["p"] for r in rows], atol=1e-9)


def test_permutation_importance(spark, matrix):
    table = {r["feature"]: r for r in ex.permutation_importance(
        lambda x: (2 * x[:, 0] - x[:, 1] > 1).astype(float), matrix, KEYS, repeats=4, seed=9, bucket_rows=200).collect()}
    assert set(table) == set(FEATURES) and all(r["repeats"] == 4 for r in table.values())
    for f in FEATURES[2:]:  # the rule does not use them
        assert table[f]["importance_mean"] == 0 and table[f]["importance_std"] == 0
    assert table["f0"]["importance_mean"] > table["f1"]["importance_mean"] > 0.02
    rows = matrix.rows.select(vector_to_array("features").alias("x"), "target").collect()
    right = np.mean([(2 * r["x"][0] - r["x"][1] > 1) == (r["target"] == 1) for r in rows])
    assert abs(table["f0"]["accuracy"] - right) < 1e-12


@pytest.mark.parametrize("resampling", md.RESAMPLINGS)
def test_no_validation_row_is_copied_or_cut(spark, matrix, resampling):
    is_train = F.col("cohort_month") <= "2001-06"
    train, valid = matrix.where(is_train), matrix.where(~is_train)
    scored = md.fold_scores(train, valid, "logistic_l2", "importance", resampling, seed=4)
    keys = sorted(tuple(r) for r in scored.select(*KEYS, "label").collect())
    assert keys == sorted(tuple(r) for r in valid.rows.select(*KEYS, "target").collect())
    part = md.resampled(train, resampling, seed=4).rows
    counts = {r["target"]: r["count"] for r in part.groupBy("target").count().collect()}
    whole = {r["target"]: r["count"] for r in train.rows.groupBy("target").count().collect()}
    wanted = {"oversample": max(whole.values()), "undersample": min(whole.values())}.get(resampling)
    assert counts == (whole if wanted is None else {k: wanted for k in whole})
    assert part.join(valid.rows.select(*KEYS), KEYS, "left_semi").count() == 0


def test_comparison_names_its_settings(matrix):
    is_train = F.col("cohort_month") <= "2001-06"
    settings = (("logistic_l2", "none", "weights"), ("forest", "elimination", "undersample"))
    rows = [r.first() for r in md.compare_models(matrix.where(is_train), matrix.where(~is_train), settings)]
    assert [(r["model"], r["selection"], r["resampling"]) for r in rows] == list(settings)
    assert all(r["roc_auc"] > 0.8 for r in rows)
    with pytest.raises(ValueError):
        md.resampled(matrix, "twice")
    with pytest.raises(ValueError):
        md.chosen_features(matrix, "best")


def test_selected_features_are_above_the_mean_and_importances_sum_to_one(frame):
    model = md.fit(frame, FEATURES, "forest", seed=1)
    importances = md.last_stage(model).featureImportances.toArray()
    assert abs(importances.sum() - 1) < 1e-9
    chosen = md.select_by_importance(model, FEATURES)
    assert set(chosen) == {f for f, v in zip(FEATURES, importances) if v > importances.mean()}


def test_score_is_the_logistic_of_the_coefficients(frame):
    model = md.fit(frame, FEATURES, "logistic_l1", max_iter=100)
    fitted = md.last_stage(model)
    for r in md.score(model, frame.limit(50)).collect():
        z = fitted.intercept + sum(c * r[f] for c, f in zip(fitted.coefficients, FEATURES))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["prediction"] == int(r["score"] >= 0.5)


def test_versions(spark, frame, tmp_path):
    versions = ModelVersions(spark, str(tmp_path))
    assert versions.list("m").count() == 0
    models = {k: md.fit(frame, FEATURES, k, max_iter=20) for k in ("logistic_l1", "logistic_l2")}
    saved = {}

    def save(kind):
        saved[kind] = versions.save(models[kind], "m", {"kind": kind})

    threads = [threading.Thread(target=save, args=(k,)) for k in models]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(saved.values()) == [1, 2]
    with pytest.raises(ValueError):
        versions.load("m")
    one, two = saved["logistic_l1"], saved["logistic_l2"]
    versions.promote("m", one)
    versions.promote("m", two, "staging")
    assert versions.latest("m") == one and versions.latest("m", "staging") == two
    versions.promote("m", two)
    listed = {r["version"]: (r["stage"], r["metrics"]) for r in versions.list("m").collect()}
    assert listed == {one: (ARCHIVED, '{"kind": "logistic_l1"}'), two: (PRODUCTION, '{"kind": "logistic_l2"}')}
    again = versions.load("m")
    assert md.last_stage(again).coefficients == md.last_stage(models["logistic_l2"]).coefficients
    assert md.last_stage(versions.load("m", one)).coefficients == md.last_stage(models["logistic_l1"]).coefficients
    versions.promote("m", one)
    assert versions.latest("m") == one
    with pytest.raises(ValueError):
        versions.promote("m", 9)
    assert versions.events("m").count() == 2 + 3 + 2 + 1


def test_learning_curve_judges_the_models_of_a_fold_in_one_pass(spark, frame, matrix, monkeypatch):
    folds = pr.expanding_month_splits(frame, "cohort_month", 2)
    written, firsts, first, write = [], [], type(frame).first, md.materialize
    monkeypatch.setattr(md, "materialize", lambda df, name, partition_by=None: written.append(partition_by) or write(df, name, partition_by))
    monkeypatch.setattr(type(frame), "first", lambda self: firsts.append(1) or first(self))
    curve = md.learning_curve(matrix, folds, (0.2, 0.4, 0.7), seed=3, max_iter=30)
    assert written == ["_step"] and len(firsts) == 2 * 2  # for each fold its sizes, then its accuracies
    assert [tuple(r)[:2] for r in curve.orderBy("fold", "fraction").collect()] == [(k, x) for k in (1, 2) for x in (0.2, 0.4, 0.7)]


def test_only_rows_with_another_value_are_predicted_anew():
    import pandas as pd

    rnd = np.random.default_rng(5)
    x = np.where(rnd.random((400, 3)) < 0.1, rnd.normal(size=(400, 3)), 0.0)
    x[:7, 1] = np.nan
    frame = pd.DataFrame({"x": list(x), "target": (x[:, 0] + x[:, 2] > 0.3).astype(float), "_bucket": 3})
    sizes = []

    def predict(rows):
        sizes.append(len(rows))
        return (rows[:, 0] + 2 * rows[:, 2] > 0.2).astype(float)

    got = ex._rotate_and_score(predict, 3, "target", 4, 9)(frame)
    assert sum(sizes) < 400 + 12 * 400 * 0.3
    for _, row in got[got["feature"] >= 0].iterrows():
        whole, j = x.copy(), row["feature"]
        whole[:, j] = np.roll(x[:, j], np.random.default_rng((9, 3, j, row["repeat"])).integers(1, 400))
        assert row["right"] == (predict(whole) == frame["target"].to_numpy()).sum() and row["n"] == 400
    assert got["right"][0] == (predict(x) == frame["target"].to_numpy()).sum()


def test_settings_with_the_same_rows_write_them_once(matrix, monkeypatch):
    is_train = F.col("cohort_month") <= "2001-06"
    train, valid = matrix.where(is_train), matrix.where(~is_train)
    settings = [(k, s, r) for s, r in (("none", "weights"), ("importance", "undersample")) for k in ("logistic_l2", "forest")]
    names, write = [], md.materialize
    monkeypatch.setattr(md, "materialize", lambda df, name, partition_by=None: names.append(name) or write(df, name, partition_by))
    rows = [r.first() for r in md.compare_models(train, valid, settings)]
    assert names == ["training-rows"] * 2
    for setting, row in zip(settings, rows):
        alone = next(iter(md.compare_models(train, valid, [setting]))).first()
        assert abs(alone["roc_auc"] - row["roc_auc"]) < 1e-6 and alone["n_features"] == row["n_features"]


def test_sizes_of_a_learning_curve_are_fitted_at_the_same_time(frame, matrix, monkeypatch):
    folds, whole, lock = pr.expanding_month_splits(frame, "cohort_month", 2), md.Matrix.fit, threading.Lock()
    meet, now, most = threading.Barrier(2), [], []

    def fit(self, *args, **kw):
        with lock:
            now.append(1)
            most.append(len(now))
        if together:
            meet.wait(60)  # breaks unless two fits are under way
        try:
            return whole(self, *args, **kw)
        finally:
            with lock:
                now.pop()

    monkeypatch.setattr(md.Matrix, "fit", fit)
    together = True
    both = md.learning_curve(matrix, folds, (0.3, 1.0), seed=3, at_once=2, max_iter=30).collect()
    assert max(most) == 2 and len(both) == 4
    together = False
    most.clear()
    assert sorted(md.learning_curve(matrix, folds, (0.3, 1.0), seed=3, at_once=1, max_iter=30).collect()) == sorted(both)
    assert max(most) == 1


def test_features_of_zeros_change_no_learning_curve(spark, monkeypatch):
    from cohortkit.plans import model_plans as mo

    rnd, rows = random.Random(2), []
    for i in range(600):
        a, b = rnd.gauss(0, 1), rnd.randint(0, 9)
        rows.append((i, f"2000-{1 + i % 9:02d}", int(a + rnd.gauss(0, 0.5) > 0), a, b, 0, 7, None, int(b > 6)))
    master = spark.createDataFrame(rows, "actor_id long, cohort_month string, target int, a double, b int, none int, same int, missing double, own_flag int")
    monkeypatch.setattr(mo, "written_master", lambda spark, sf: master)
    whole, is_train = mo.model_matrix(spark, "")
    less, _ = mo.model_matrix(spark, "", zeros=False)
    assert whole.features == ["a", "b", "none", "same", "missing", "own_flag"] and less.features == ["a", "b", "own_flag"]
    values = {r["actor_id"]: r["x"] for r in whole.rows.select("actor_id", vector_to_array("features").alias("x")).collect()}
    for r in less.rows.select("actor_id", vector_to_array("features").alias("x")).collect():
        x = values[r["actor_id"]]
        assert x[2:5] == [0.0] * 3 and r["x"] == [x[0], x[1], x[5]]
    folds = pr.expanding_month_splits(master, "cohort_month", 2)
    curves = [md.learning_curve(m, folds, (0.4, 1.0), seed=1, max_iter=20).collect() for m in (whole, less)]
    assert sorted(curves[0]) == sorted(curves[1]) and len(curves[0]) == 4


def test_settings_of_a_comparison_are_fitted_at_the_same_time(matrix, monkeypatch):
    is_train = F.col("cohort_month") <= "2001-06"
    train, valid = matrix.where(is_train), matrix.where(~is_train)
    settings = [("logistic_l2", "none", "weights"), ("mlp", "none", "weights"), ("logistic_l2", "none", "undersample")]
    meet, whole, kinds, once = threading.Barrier(2), md.fold_scores, [], []

    def scores(train, valid, kind, *args, **kw):
        kinds.append(kind)
        if not once:
            meet.wait(60)  # breaks unless two settings are under way
            once.append(1)
        return whole(train, valid, kind, *args, **kw)

    monkeypatch.setattr(md, "fold_scores", scores)
    rows = [r.first() for r in md.compare_models(train, valid, settings, at_once=2)]
    assert sorted(kinds[:2]) == ["logistic_l2", "mlp"] and len(kinds) == 3
    assert [(r["model"], r["selection"], r["resampling"]) for r in rows] == settings  # in the order asked for
    kinds.clear()
    alone = [r.first() for r in md.compare_models(train, valid, settings, at_once=1)]
    assert kinds == ["mlp", "logistic_l2", "logistic_l2"] and [r["roc_auc"] for r in alone] == pytest.approx([r["roc_auc"] for r in rows], abs=1e-6)
