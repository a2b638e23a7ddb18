import os

import pytest

from cohortkit.config import TEST_CONFIG
from cohortkit.plans import feature_plans as fp
from cohortkit.workflow import run_study

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_run_study_end_to_end(spark, tmp_path):
    spec = dict(codes=fp.SPEC_CODES, fallback_parts=fp.SPEC_PARTS, fallback_group=fp.SPEC_FALLBACK)
    res = run_study(spark, SF, TEST_CONFIG, fp.CLASSES, spec, fp.AGE_YEAR, out_dir=str(tmp_path))
    master = spark.read.parquet(res["paths"]["master"])
    spine = spark.read.parquet(res["paths"]["spine"])
    assert master.count() == spine.count() > 0
    assert set(res["paths"]) >= {"events", "spine", "monthly_features", "master", "model", "scores"}
    assert res["metrics"]["tp"] + res["metrics"]["fn"] + res["metrics"]["tn"] + res["metrics"]["fp"] > 0
