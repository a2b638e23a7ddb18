from dataclasses import replace

from pyspark.sql import functions as F

from cohortkit.config import StudyConfig
from cohortkit.operators import cohort as co
from event_rows import make_events

CFG = StudyConfig(first_month="1998-01", study_start="2001-01", study_end="2001-06", lookback_months=24,
                  target_product="T")


def classes(spark, rows, cfg=CFG, **kw):
    ev = make_events(spark, rows)
    return {r["actor_id"]: r.asDict() for r in co.actor_classes(ev, cfg, **kw).collect()}


def test_lookback_edges(spark):
    # anchor 2001-01: window is [1998-12, 2001-01): -25 counted, -26 not, same month not
    rows = [(1, 1, "1998-11-05", "T"), (1, 2, "1998-12-05", "T"), (1, 3, "1999-01-05", "T"),
            (1, 4, "2000-12-05", "T"), (1, 5, "2001-01-15", "T"), (1, 6, "2001-01-20", "T")]
    c = classes(spark, rows)[1]
    assert c["anchor_month"] == "2001-01"
    assert c["lookback_start_month"] == "1998-12"
    assert c["target_rows"] == 3 and c["target_subjects"] == 3
    assert c["actor_class"] == "existing"


def test_month_clamp(spark):
    ev = make_events(spark, [(1, 1, "2001-03-31", "T")])
    r = co.first_event(ev, "2001-01-01", "2001-06-30", 0, "T").first()
    assert str(r["lookback_start_date"]) == "2001-02-28"
    assert r["lookback_start_month"] == "2001-02"


def test_day_lookback(spark):
    rows = [(1, 10, "1999-03-10", "T"), (1, 10, "2001-03-10", "T"),
            (1, 11, "1999-03-09", "T"), (1, 11, "2001-03-10", "T"),
            (1, 12, "2001-03-10", "T"), (1, 12, "2001-03-10", "T")]
    ev = make_events(spark, rows)
    res = {r["subject_id"]: r["status"] for r in co.new_to_product(ev, "T", "2001-01-01", 2).collect()}
    assert res == {10: "existing", 11: "new", 12: "new"}


def test_four_classes(spark):
    rows = [
        (1, 1, "1999-05-01", "X"), (1, 1, "2001-02-01", "T"),                              # new
        (2, 1, "1999-05-01", "T"), (2, 1, "2001-02-01", "T"),                              # existing
        (3, 1, "1999-05-01", "T"), (3, 1, "2001-02-01", "X"),                              # discontinued
        (4, 1, "1999-05-01", "X"), (4, 1, "2001-02-01", "X"),                              # never
        (5, 1, "1999-05-01", "X"),                                                         # prior only
        (6, 1, "2001-02-01", "X"),                                                         # study only
    ]
    c = classes(spark, rows)
    assert {k: v["actor_class"] for k, v in c.items()} == {1: "new", 2: "existing", 3: "discontinued", 4: "never"}


def test_null_product_is_other(spark):
    rows = [(1, 1, "2000-05-01", None), (1, 2, "2001-02-01", "X")]
    c = classes(spark, rows)[1]
    assert c["other_rows"] == 1 and c["target_rows"] == 0 and c["actor_class"] == "never"


def test_never_rows_per_active_month(spark):
    rows = [(1, 1, "2000-05-01", "X"), (1, 1, "2001-02-01", "X"), (1, 2, "2001-02-11", "X"),
            (1, 1, "2001-03-01", "X"), (1, 1, "2001-05-01", "X"),
            (2, 1, "2000-05-01", "X"), (2, 1, "2001-04-03", "T")]
    ev = make_events(spark, rows)
    sp = sorted((r["actor_id"], r["cohort_month"], r["target"]) for r in co.target_spine(ev, CFG).collect())
    assert sp == [(1, "2001-02", 0), (1, "2001-03", 0), (1, "2001-05", 0), (2, "2001-04", 1)]
    allm = co.target_spine(ev, CFG, never_months="all").filter("actor_id = 1").count()
    assert allm == 6
    first = co.target_spine(ev, CFG, never_months="first").filter("actor_id = 1").collect()
    assert [r["cohort_month"] for r in first] == ["2001-02"]


def test_row_level_nonusers_overlap(spark):
    rows = [(1, 1, "2000-05-01", "X"), (1, 1, "2001-02-01", "T"), (1, 2, "2001-03-01", "X")]
    ev = make_events(spark, rows)
    sp = co.target_spine(ev, CFG, row_level_nonusers=True)
    assert co.spine_disjoint_check(sp).count() == 1
    assert co.spine_disjoint_check(co.target_spine(ev, CFG)).count() == 0


def test_nonuser_lookback_parameter(spark):
    # target row 30 months before the anchor: outside 24, inside 36
    rows = [(1, 1, "1998-08-01", "T"), (1, 1, "2001-02-01", "X")]
    assert classes(spark, rows)[1]["actor_class"] == "never"
    assert classes(spark, rows, nonuser_lookback_months=36)[1]["actor_class"] == "discontinued"


def test_new_to_product_monthly_counts(spark):
    rows = [(1, 10, "2001-02-01", "T"), (1, 11, "2001-02-05", "T"), (1, 11, "2000-02-05", "T")]
    ev = make_events(spark, rows)
    m = co.new_to_product_monthly(co.new_to_product(ev, "T", "2001-01-01", 2)).first()
    assert (m["index_month"], m["new_count"], m["existing_count"], m["total_count"]) == ("2001-02", 1, 1, 2)
