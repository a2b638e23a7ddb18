"""End-to-end study run: the sequence a user of the reference runs notebook by
notebook (extract -> clean -> spine -> features -> master -> train ->
evaluate -> score), as one function whose every stage is written to the
shared folder and read back.

Writing each stage (``write_table``) cuts lineage: a lost executor re-reads
the previous stage's files instead of recomputing from the raw tables, and a
rerun can start from any written stage.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortkit.config import StudyConfig
from cohortkit.operators import cohort as co
from cohortkit.operators import features as fe
from cohortkit.operators import master as ma
from cohortkit.operators import quality as qa
from cohortkit.modeling import metrics as mt
from cohortkit.modeling import models as md
from cohortkit.modeling import prep as pr
from cohortkit.modeling.versions import ModelVersions
from cohortkit.session import checkpoint_dir
from cohortkit.sources.roles import actor_profile, affiliations, event_log
from cohortkit.sources.tables import read_written, write_table

KEYS = ["actor_id", "cohort_month"]


def run_study(spark: SparkSession, sf_dir: str, cfg: StudyConfig, classes, spec: dict,
              age_year: tuple[str, str], out_dir: str | None = None, fit: bool = True) -> dict:
    """Run the whole study; returns the written paths and the held-out metrics row."""
    out = out_dir or os.path.join(checkpoint_dir(spark), "study", uuid.uuid4().hex)
    paths = {}

    def stage(name, df, partition_by=None):
        p = os.path.join(out, name)
        write_table(df, p, partition_by=partition_by)
        paths[name] = p
        return read_written(spark, p)

    # 1-2: extract and clean (conflicted subjects removed), partitioned by month for pruning
    ev = stage("events", qa.drop_conflicting(event_log(spark, sf_dir), "subject_id", "birth_year_alt"),
               partition_by="month")
    # 3: label definition
    spine = stage("spine", co.target_spine(ev, cfg))
    # 4: features
    affl = stage("affiliations", affiliations(spark, sf_dir, ev))
    shares = fe.share_wide(ev, cfg.named_products, cfg.product_groups, cfg.study_start, cfg.study_end,
                           cfg.lag_months, cfg.bucket_edges)
    orgf = fe.org_flag(ev).withColumnRenamed("month", "cohort_month")
    peer = fe.peer_use_flag(ev, affl, cfg.target_product, cfg.study_start, cfg.study_end,
                            cfg.lag_months).drop("org_id")
    monthly = stage("monthly_features", shares.join(orgf, KEYS, "full").join(peer, KEYS, "full")
                    .fillna(0, ["org_flag", "peer_flag"]))
    breadth = stage("class_breadth", fe.class_breadth_lookback(ev, classes, cfg.study_start, cfg.study_end))
    own = stage("own_use", fe.own_use_flag(ev, affl, cfg.target_product, cfg.study_start, cfg.study_end,
                                           cfg.lag_months))
    chars = stage("characteristics", fe.actor_characteristics(
        fe.subject_counts(ev, *age_year), fe.age_band_counts(ev, age_year[0], age_year[1], cfg.as_of_date),
        fe.specialty_group(actor_profile(spark, sf_dir), **spec), affl, fe.org_size(affl)))
    # 5: master table (unique-key guards inside the join job)
    master = stage("master", ma.master_table(spine, [("monthly", monthly, KEYS), ("breadth", breadth, KEYS),
                                                     ("own", own, KEYS), ("characteristics", chars, ["actor_id"])]))
    result = {"paths": paths, "metrics": None}
    if not fit:
        return result
    # 6-7: temporal split, train-only scaling, balanced weights, L1 logistic, evaluate, save, score
    feats = [c for c, t in master.dtypes if c not in ("actor_id", "cohort_month", "target", "org_id")
             and t in ("int", "bigint", "double")]
    m = master.select(*KEYS, "target", *[F.col(c).cast("double").alias(c) for c in feats])
    train, test = pr.temporal_split(m, "cohort_month", cfg.train_end)
    stats = pr.fit_scaler(train, feats)
    train_s = pr.apply_scaler(train, stats, feats).fillna(0.0)
    test_s = pr.apply_scaler(test, stats, feats).fillna(0.0)
    model = md.fit(pr.with_class_weight(train_s, "target"), feats, "logistic_l1", weight_col="weight",
                   seed=cfg.seed)
    versions = ModelVersions(spark, os.path.join(out, "models"))
    version = versions.save(model, "propensity")
    versions.promote("propensity", version)
    paths["model"] = f"{versions.root}/propensity/v={version}"
    scored = stage("scores", md.score(model, train_s.unionByName(test_s)).select(*KEYS, "target", "score",
                                                                                 "prediction"))
    held_out = scored.filter(F.col("cohort_month") > cfg.train_end).select(F.col("target").alias("label"), "score")
    result["metrics"] = mt.classification_metrics(held_out).first().asDict()  # one row
    return result
