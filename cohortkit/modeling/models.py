"""Estimators on pyspark.ml.

Fitting is distributed (executors aggregate gradients / tree statistics);
only model parameters live on the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cohortkit.session import materialize

KINDS = ("logistic_l1", "logistic_l2", "forest", "boosted", "mlp")


def make_estimator(kind: str, n_features: int, label: str = "target", weight_col: str | None = None,
                   seed: int = 42, reg: float = 0.0, max_iter: int = 1000):
    common = dict(featuresCol="features", labelCol=label)
    if kind in ("logistic_l1", "logistic_l2"):
        est = LogisticRegression(maxIter=max_iter, regParam=reg,
                                 elasticNetParam=1.0 if kind == "logistic_l1" else 0.0, **common)
    elif kind == "forest":
        est = RandomForestClassifier(numTrees=100, seed=seed, **common)
    elif kind == "boosted":
        est = GBTClassifier(seed=seed, **common)
    elif kind == "mlp":
        est = MultilayerPerceptronClassifier(layers=[n_features, 50, 25, 5, 2], seed=seed, maxIter=200, **common)
    else:
        raise ValueError(f"unknown model kind {kind}")
    if weight_col and kind != "mlp" and est.hasParam("weightCol"):
        est = est.setWeightCol(weight_col)
    return est


def fit(train: DataFrame, features, kind: str = "logistic_l1", label: str = "target",
        weight_col: str | None = None, seed: int = 42, **kw) -> PipelineModel:
    """Assemble features and fit one estimator as a PipelineModel."""
    features = list(features)
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    if kind in ("logistic_l1", "logistic_l2") and "reg" not in kw:
        # penalty of strength 1 on the summed loss; the estimator averages the loss over the weights
        total = train.agg(F.sum(weight_col) if weight_col else F.count(F.lit(1))).first()[0]
        kw["reg"] = 1.0 / total if total else 0.0
    est = make_estimator(kind, len(features), label, weight_col, seed, **kw)
    # every estimator keeps the rows in its own form for its iterations (blocks,
    # binned points, stacks) after one to three passes over the frame, which
    # its callers have written: rows kept here too would be held twice
    cols = [label] + ([weight_col] if weight_col else [])
    return PipelineModel(stages=[asm, est.fit(asm.transform(train).select("features", *cols))])


def score(model: PipelineModel, df: DataFrame, score_col: str = "score", pred_col: str = "prediction",
          threshold: float = 0.5) -> DataFrame:
    """Add the class-1 probability and the 0/1 label at ``threshold``."""
    out = model.transform(df)
    p1 = vector_to_array("probability")[1]
    keep = [c for c in df.columns]
    return out.select(*keep, p1.alias(score_col), (p1 >= threshold).cast("int").alias(pred_col))


def last_stage(model: PipelineModel):
    return model.stages[-1]


def select_by_importance(model: PipelineModel, features, max_features: int = 50) -> list:
    """Forest importances above their mean, at most ``max_features`` (largest first)."""
    imp = list(last_stage(model).featureImportances.toArray())
    mean = sum(imp) / len(imp) if imp else 0.0
    ranked = sorted([(v, f) for f, v in zip(features, imp) if v > mean], key=lambda x: (-x[0], x[1]))
    return [f for _, f in ranked[:max_features]]


class Matrix:
    """Rows assembled once: a feature vector beside the kept columns, written to the shared folder.

    Searches that fit many models on subsets of the features slice the vector
    instead of assembling the rows anew.
    """

    def __init__(self, rows: DataFrame, features) -> None:
        self.rows, self.features = rows, list(features)

    @classmethod
    def of(cls, df: DataFrame, features, keep, written: bool = True) -> Matrix:
        features = list(features)
        rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df).select(*keep, "features")
        return cls(materialize(rows, "matrix") if written else rows, features)

    def where(self, condition) -> Matrix:
        return Matrix(self.rows.where(condition), self.features)

    def sliced(self, features) -> Matrix:
        """The same rows with the named features only."""
        features = list(features)
        if features == self.features:
            return self
        at = [self.features.index(f) for f in features]
        rows = VectorSlicer(inputCol="_all", outputCol="features", indices=at).transform(self.rows.withColumnRenamed("features", "_all"))
        return Matrix(rows.drop("_all"), features)

    def fit(self, kind: str, label: str = "target", weight_col: str | None = None, seed: int = 42, **kw):
        """A fitted model of the vector column."""
        if kind in ("logistic_l1", "logistic_l2") and "reg" not in kw:
            total = self.rows.agg(F.sum(weight_col) if weight_col else F.count(F.lit(1))).first()[0]
            kw["reg"] = 1.0 / total if total else 0.0
        return make_estimator(kind, len(self.features), label, weight_col, seed, **kw).fit(self.rows)


def recursive_elimination(matrix: Matrix, label: str = "target", keep: int = 50, step: int = 1, **kw) -> list[tuple[int, str, float]]:
    """Refit an L2 logistic model and drop the ``step`` smallest |coefficients| (ties by name) until ``keep`` remain.

    Returns (round, feature, |coefficient| in that round's model) in the order
    of elimination, then the kept features with round 0 and their coefficient
    in the last model.  The rows are read from the written matrix each time.
    """
    if step < 1:
        raise ValueError("step must be at least 1")
    left, out, number = list(matrix.features), [], 0
    while True:
        fitted = matrix.sliced(left).fit("logistic_l2", label, **kw)
        order = sorted(zip((abs(float(c)) for c in fitted.coefficients.toArray()), left))
        if len(left) <= keep:
            return out + [(0, f, c) for c, f in reversed(order)]
        number += 1
        gone = order[:min(step, len(left) - keep)]
        out += [(number, f, c) for c, f in gone]
        left = [f for f in left if f not in {f for _, f in gone}]


def prefix_place(keys, seed: int):
    """A row's place in a fixed hash order of its keys, in [0, 1)."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


#: Fits of a search that run at the same time; each holds its own rows in blocks.
FITS_AT_ONCE = 4


def learning_curve(matrix: Matrix, folds: DataFrame, fractions, label: str = "target", month_col: str = "cohort_month",
                   keys=("actor_id", "cohort_month"), kind: str = "logistic_l2", seed: int = 42,
                   at_once: int = FITS_AT_ONCE, **kw) -> DataFrame:
    """Accuracy on training and validation rows at growing sizes, over expanding folds.

    A size is the prefix of the training months' rows in one hash order, so
    every size contains the smaller ones.  Returns a row for each fold and
    fraction: (fold, fraction, n_train, n_valid, train_accuracy, valid_accuracy).
    ``folds`` has the month ranges of ``prep.expanding_month_splits``: a
    handful of rows.  A size with one class only is left out.

    The rows are written in one folder for each step between two sizes, so
    that a fit reads its prefix only, and all models of a fold are judged in
    one pass.  ``at_once`` fits run at the same time, and a fold is judged
    while the next ones are fitted.
    """
    fractions = sorted(float(x) for x in fractions)
    step = sum((F.col("_place") >= x).cast("int") for x in fractions)
    steps = matrix.rows.withColumn("_place", prefix_place(keys, seed)).withColumn("_step", step).drop("_place")
    placed = Matrix(materialize(steps, "learning-steps", partition_by="_step"), matrix.features)
    spark, rows, fitting = matrix.rows.sparkSession, [], []
    pool = ThreadPoolExecutor(at_once)
    try:
        for fold in folds.orderBy("fold").collect():
            months = placed.where(F.col(month_col) <= fold["valid_to"])
            is_train = F.col(month_col) <= fold["train_to"]
            inside = [is_train & (F.col("_step") <= i) for i in range(len(fractions))]
            sizes = months.rows.agg(*[f(F.when(x, F.col(label) if f is not F.count else 1)) for x in inside for f in (F.count, F.min, F.max)]).first()
            models = {}
            for i, x in enumerate(inside):
                n, low, high = sizes[3 * i:3 * i + 3]
                if n == 0 or low == high:
                    continue
                penalty = {"reg": 1.0 / n} if kind in ("logistic_l1", "logistic_l2") else {}
                fit_one = inheritable_thread_target(spark)(months.where(x).fit)
                models[i] = pool.submit(fit_one, kind, label, seed=seed, **{**penalty, **kw})
            if models:
                fitting.append((fold["fold"], months.rows, is_train, inside, models))
        for number, judged, is_train, inside, models in fitting:
            for i, model in models.items():
                judged = model.result().setPredictionCol(f"_prediction_{i}").setRawPredictionCol("").setProbabilityCol("").transform(judged)
            right = {i: (F.col(f"_prediction_{i}") == F.col(label)).cast("double") for i in models}
            one = judged.agg(*[a for i in models for a in (
                F.count(F.when(inside[i], 1)), F.count(F.when(~is_train, 1)), F.avg(F.when(inside[i], right[i])), F.avg(F.when(~is_train, right[i])))]).first()
            rows += [(number, fractions[i], *one[4 * k:4 * k + 4]) for k, i in enumerate(models)]
    finally:
        pool.shutdown(cancel_futures=True)
    return spark.createDataFrame(
        rows, "fold int, fraction double, n_train long, n_valid long, train_accuracy double, valid_accuracy double")


def learning_curve_summary(curve: DataFrame) -> DataFrame:
    """Mean and deviation over the folds for each fraction."""
    return curve.groupBy("fraction").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("n_train").alias("mean_train_rows"),
        *[fn(c).alias(f"{c}_{n}") for c in ("train_accuracy", "valid_accuracy") for n, fn in (("mean", F.avg), ("std", F.stddev_samp))])


#: Settings of a comparison that are fitted at the same time, beside the choice of features for the next ones.
SETTINGS_AT_ONCE = 2

SELECTIONS = ("none", "importance", "elimination")
RESAMPLINGS = ("none", "weights", "oversample", "undersample")


def chosen_features(train: Matrix, selection: str, label: str = "target", most: int = 50, seed: int = 42, **kw) -> list:
    """Features that a selection keeps, found on training rows only."""
    if selection == "none":
        return train.features
    if selection == "importance":
        weights = train.fit("forest", label, seed=seed).featureImportances.toArray()
        mean = sum(weights) / len(weights)
        best = sorted((-float(w), f) for f, w in zip(train.features, weights) if w > mean)
        return [f for _, f in best[:most]] or train.features
    if selection == "elimination":
        return [f for n, f, _ in recursive_elimination(train, label, most, **kw) if n == 0]
    raise ValueError(f"unknown selection {selection}")


def resampled(train: Matrix, resampling: str, label: str = "target", keys=("actor_id", "cohort_month"), seed: int = 42) -> Matrix:
    """Training rows with the class balance that ``resampling`` asks for, and their weight."""
    from cohortkit.modeling import prep

    if resampling == "weights":
        rows = prep.with_class_weight(train.rows, label)
    elif resampling == "oversample":
        rows = prep.oversample(train.rows, label, list(keys), seed).drop("copy")
    elif resampling == "undersample":
        rows = prep.undersample(train.rows, label, list(keys), seed)
    elif resampling == "none":
        rows = train.rows
    else:
        raise ValueError(f"unknown resampling {resampling}")
    return Matrix(rows if resampling == "weights" else rows.withColumn("weight", F.lit(1.0)), train.features)


def training_rows(train: Matrix, features, resampling: str, label: str = "target", keys=("actor_id", "cohort_month"),
                  seed: int = 42) -> Matrix:
    """The rows that a setting is fitted on, written."""
    part = resampled(train.sliced(features), resampling, label, keys, seed)
    return Matrix(materialize(part.rows, "training-rows"), features)


def fold_scores(train: Matrix, valid: Matrix, kind: str, selection: str = "none", resampling: str = "weights",
                label: str = "target", keys=("actor_id", "cohort_month"), seed: int = 42, written: Matrix | None = None) -> DataFrame:
    """Select and resample on the training rows, fit, and score every validation row once, as it is.

    ``written`` holds the setting's training rows where another one has written them.
    """
    if written is None:
        written = training_rows(train, chosen_features(train, selection, label, seed=seed), resampling, label, keys, seed)
    fitted = written.fit(kind, label, weight_col="weight" if kind != "mlp" else None, seed=seed)
    out = fitted.transform(valid.sliced(written.features).rows)
    return out.select(*keys, F.col(label).alias("label"), vector_to_array("probability")[1].alias("score"))


def compare_models(train: Matrix, valid: Matrix, settings, label: str = "target", keys=("actor_id", "cohort_month"), seed: int = 42,
                   at_once: int = SETTINGS_AT_ONCE):
    """One metrics row for each (kind, selection, resampling); fits are distributed, the loop runs over the settings.

    Kinds with one selection and resampling are fitted on the same rows, which are written once.  ``at_once``
    settings are fitted and judged at the same time, while the rows of the next ones are chosen and written;
    a network, which takes the most rounds, is begun before the others on its rows.
    """
    settings, chosen, written, found = list(settings), {}, {}, {}

    def judged(kind, selection, resampling):
        from cohortkit.modeling.metrics import classification_metrics

        scored = fold_scores(train, valid, kind, selection, resampling, label, keys, seed, written[selection, resampling])
        return classification_metrics(scored).select(
            F.lit(kind).alias("model"), F.lit(selection).alias("selection"), F.lit(resampling).alias("resampling"),
            F.lit(len(chosen[selection])).alias("n_features"), "*")

    judge, pool = inheritable_thread_target(train.rows.sparkSession)(judged), ThreadPoolExecutor(at_once)
    try:
        for selection, resampling in dict.fromkeys(s[1:] for s in settings):
            if selection not in chosen:
                chosen[selection] = chosen_features(train, selection, label, seed=seed)
            written[selection, resampling] = training_rows(train, chosen[selection], resampling, label, keys, seed)
            for kind in sorted((k for k, *rest in settings if rest == [selection, resampling]), key=lambda k: k != "mlp"):
                found[kind, selection, resampling] = pool.submit(judge, kind, selection, resampling)
        for setting in settings:
            yield found[setting].result()
    finally:
        pool.shutdown(cancel_futures=True)
