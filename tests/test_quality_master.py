import pytest
from pyspark.sql import functions as F

from cohortkit.operators import master as ma
from cohortkit.operators import quality as qa
from cohortkit.operators import timeline as tl
from event_rows import make_events


def test_conflicting_subjects(spark):
    df = spark.createDataFrame([(1, 1980), (1, 1981), (2, 1980), (2, None), (3, 1980), (3, 1980)],
                               "subject_id long, by int")
    assert [r[0] for r in qa.find_conflicting(df, "subject_id", "by").collect()] == [1]
    assert sorted(r[0] for r in qa.drop_conflicting(df, "subject_id", "by").collect()) == [2, 2, 3, 3]


def test_source_mismatch(spark):
    df = spark.createDataFrame([(1, 1980, 1980), (2, 1980, 1981), (3, 1980, None)], "s long, a int, b int")
    got = [(r["s"], r["n_mismatch"], r["is_max"]) for r in qa.source_mismatch(df, "s", "a", "b").collect()]
    assert got == [(2, 1, 1)]


def test_duplicate_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a long, b string")
    got = [(r["a"], r["b"], r["n_copies"]) for r in qa.duplicate_rows(df).collect()]
    assert got == [(1, None, 2)]


def test_table_profile_top_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), ("d",), (None,)], "v string")
    r = qa.table_profile(df, ["v"], 3).first()
    assert r["top_values"] == "b, c, a" and r["n_distinct"] == 4 and abs(r["null_pct"] - 100 / 7) < 1e-5


def test_duplicate_right_key_fails(spark):
    spine = spark.createDataFrame([(1, "2001-01", 1)], "actor_id long, cohort_month string, target int")
    feat = spark.createDataFrame([(1, "2001-01", 5), (1, "2001-01", 6)], "actor_id long, cohort_month string, f int")
    with pytest.raises(Exception, match="duplicate key"):
        ma.master_table(spine, [("feat", feat, None)]).collect()


def test_master_preserves_grain_and_fills(spark):
    spine = spark.createDataFrame([(1, "2001-01", 1), (2, "2001-01", 0)], "actor_id long, cohort_month string, target int")
    feat = spark.createDataFrame([(1, "2001-01", 5)], "actor_id long, cohort_month string, f int")
    out = sorted((r["actor_id"], r["f"]) for r in ma.master_table(spine, [("feat", feat, None)]).collect())
    assert out == [(1, 5), (2, 0)]


def test_dense_rank_ties_kept(spark):
    counts = spark.createDataFrame([(1, 5), (2, 5), (3, 3), (4, 2)], "id long, n long")
    got = sorted(r["id"] for r in tl.rank_ids_by_count(counts, "id", "n", 2).collect())
    assert got == [1, 2, 3]


def test_timeline_order_and_gap(spark):
    rows = [(1, 9, "2001-01-02", "B"), (1, 9, "2001-01-03", "A"), (1, 9, "2001-02-06", "A")]
    ev = make_events(spark, rows)
    h = tl.history_string(tl.therapy_timeline(ev, "2001-01-01")).first()
    assert h["history"] == "||A-0, ||B-0, A-0"
    assert h["max_gap_weeks"] == 5 and h["total_weeks"] == 5


def test_sample_one_id_deterministic(spark):
    df = spark.createDataFrame([(i, j) for i in range(20) for j in range(3)], "id long, v long")
    a = sorted(qa.sample_one_id(df, "id", 42).collect())
    b = sorted(qa.sample_one_id(df, "id", 42).collect())
    assert a == b and len(a) == 3
