"""Plans and results of the steps that decide how time, shuffle and memory grow with the log."""

import pytest
from event_rows import d, make_events
from pyspark.sql import functions as F

from cohortkit.config import StudyConfig
from cohortkit.modeling import models as md
from cohortkit.modeling import prep as pr
from cohortkit.operators import cohort as co
from cohortkit.operators import features as fe
from cohortkit.operators import master as ma
from cohortkit.operators import panel as pn
from cohortkit.operators import shape as sh
from cohortkit.operators import timeline as tl
from cohortkit.plans import feature_plans as fp
from cohortkit.sources.roles import event_log

CFG = StudyConfig(first_month="1995-01", study_start="1999-10", study_end="2001-08", lookback_months=24)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(df):
    return _plan(df).count("Exchange hashpartitioning")


def _events(spark):
    rows = [(1, 5, "1998-01-10", "Brand#13"), (1, 5, "2000-02-10", "Brand#12"), (1, 6, "2000-05-02", "Brand#12"),
            (2, 5, "1999-08-01", "Brand#12"), (2, 7, "2000-01-05", "Brand#12"), (3, 7, "1997-01-05", "Brand#14"),
            (3, 8, "2000-03-05", "Brand#14"), (3, 8, "2001-08-31", "Brand#13"), (4, None, "1999-01-01", "Brand#12"),
            (4, 9, "2000-06-06", None), (5, 9, "1999-11-11", "Brand#12"),
            (None, 5, "1999-06-01", "Brand#12"), (None, 6, "2000-07-01", "Brand#12")]
    return make_events(spark, rows)


@pytest.mark.parametrize("how", [{}, {"row_level_nonusers": True}, {"nonuser_lookback_months": 70}, {"require_inclusion": False}])
def test_spine_reads_the_events_once_and_agrees_with_the_classes(spark, how):
    ev = _events(spark)
    spine = co.target_spine(ev, CFG, **how)
    assert _plan(spine).count("Scan ExistingRDD") == 1
    classes = co.actor_classes(ev, CFG, keep_months=True, **how)
    slow = co.target_spine(ev, CFG, classes=classes)
    assert sorted(map(str, spine.collect())) == sorted(map(str, slow.collect())) != []


@pytest.mark.parametrize("cumulative", [False, True])
@pytest.mark.parametrize("lag", [0, 2])
def test_recency_counts_with_one_narrow_shuffle(spark, lag, cumulative):
    days = ["2000-01-05", "2000-01-20", "2000-03-01", "2000-04-09", "2000-09-30"]
    ev = make_events(spark, [(a, s, day, "P") for a in (1, 2) for s in (5, None, 6) for day in days[a - 1:] if s != 6 or day > "2000-03"])
    got = pn.recency_counts(ev, lag, "2000-02", "2001-08", (1, 3, 6, 9, 12), cumulative)
    assert _shuffles(got) == 1
    want = {}
    for r in ev.collect():
        m = r["event_date"].year * 12 + r["event_date"].month - 1
        for c in range(2000 * 12 + 1, 2001 * 12 + 8):
            gap, low = c - lag - m, 0
            for e in (1, 3, 6, 9, 12):
                if (0 if cumulative else low) < gap <= e:
                    n, s = want.setdefault((r["actor_id"], c, e), ([], set()))
                    n.append(1)
                    s |= {r["subject_id"]} - {None}
                low = e
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == {k: (len(n), len(s)) for k, (n, s) in want.items()}


def test_weekly_wide_and_deviations_share_one_shuffle(spark):
    week = d("2000-01-03")
    weekly = spark.createDataFrame([(1, "P1", "0", week, 2.0), (1, "P1", "9", week, 3.0), (1, "P1", "0", d("2000-01-10"), 5.0), (2, "Q", "0", week, None)],
                                   "subject_id long, product string, use string, week date, quantity double")
    labels = [tl.quantity_label(p, u) for p in ("P1", "P2") for u in ("0", "1")] + [tl.OTHER_LABEL]
    wide = tl.weekly_wide(weekly, labels)
    assert sorted(map(tuple, wide.collect())) == [(1, week, 2.0, 0.0, 0.0, 0.0, 3.0), (1, d("2000-01-10"), 5.0, 0.0, 0.0, 0.0, 0.0),
                                                  (2, week, 0.0, 0.0, 0.0, 0.0, 0.0)]
    std = tl.column_stddevs(wide, "subject_id", ["QTY_P1_USE_0"], weeks=F.count("week"))
    assert _shuffles(std) == 1
    assert {r["subject_id"]: (round(r["std_QTY_P1_USE_0"] or 0, 4), r["weeks"]) for r in std.collect()} == {1: (2.1213, 2), 2: (0, 1)}


def test_many_categories_without_a_buffer_for_each(spark):
    long = spark.createDataFrame([(1, f"c{i}", i, i * 2.0) for i in range(20)] + [(2, "else", 1, 1.0), (3, None, 1, 1.0), (1, "c3", 4, None)],
                                 "k int, c string, n int, q double")
    wide = sh.long_to_wide(long, "k", "c", ["n", "q"], [f"c{i}" for i in range(20)], agg="sum")
    assert "pivotfirst" not in _plan(wide).lower()
    rows = {r["k"]: r for r in wide.collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1]["c3_n"] == 7 and rows[1]["c3_q"] == 6.0 and rows[1]["c19_n"] == 19
    assert rows[2]["c0_n"] is None and rows[3]["c0_q"] is None


def test_breadth_is_dealt_by_actor_once(spark):
    ev = _events(spark).withColumn("product_group", F.lit(fp.CLASSES[0]))
    breadth = fe.class_breadth_lookback(ev, fp.CLASSES, CFG.study_start, CFG.study_end, 0, 12, dense=False)
    assert _shuffles(breadth) == 1
    one = breadth.filter("actor_id = 1 and cohort_month = '2000-06'").first()
    assert one[f"N_{fp.CLASSES[0]}_12M"] == 2 and one[f"N_{fp.CLASSES[1]}_12M"] == 0


def test_master_lays_maps_out_after_the_last_join(spark):
    spine = spark.createDataFrame([(1, "2000-01", 0), (2, "2000-01", 1)], "actor_id long, cohort_month string, target int")
    maps = spark.createDataFrame([(1, "2000-01", {"a": 2})], "actor_id long, cohort_month string, _m map<string,int>")
    size = spark.createDataFrame([(2, 7)], "actor_id long, size int")
    out = ma.master_table(spine, [("maps", maps, None), ("size", size, ["actor_id"])],
                          expand={"_m": [F.coalesce(F.try_element_at("_m", F.lit(x)), F.lit(0)).alias(x) for x in "ab"]})
    assert out.columns == ["actor_id", "cohort_month", "target", "a", "b", "size"]
    assert sorted(map(tuple, out.collect())) == [(1, "2000-01", 0, 2, 0, 0), (2, "2000-01", 1, 0, 0, 7)]
    with pytest.raises(ValueError, match="already present"):
        ma.master_table(spine, [("maps", maps, None)], expand={"_m": [F.lit(1).alias("target")]})


def test_fit_does_not_hold_the_rows_a_second_time(spark, monkeypatch):
    train = spark.createDataFrame([(float(i % 7), float(i % 3), i % 2) for i in range(60)], "a double, b double, target int")

    def persist(*_, **__):
        raise AssertionError("rows held twice")

    monkeypatch.setattr(type(train), "persist", persist)
    assert len(md.last_stage(md.fit(train, ["a", "b"], "logistic_l2", max_iter=5)).coefficients) == 2


def test_event_log_of_one_product(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("lineitem", [(1, 1, 5, 1, 2.0, "A", "F", d("2000-01-01")), (1, 2, 5, 2, 3.0, "N", "O", d("2000-02-01")), (2, 1, 6, 1, 4.0, "R", "O", None)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate date")
    write("orders", [(1, 10), (2, 11)], "o_orderkey long, o_custkey long")
    write("part", [(1, "P", "x"), (2, None, "y")], "p_partkey long, p_brand string, p_type string")
    whole = event_log(spark, str(tmp_path)).filter("product = 'P'")
    one = event_log(spark, str(tmp_path), product="P")
    assert one.columns == whole.columns and sorted(map(str, one.collect())) == sorted(map(str, whole.collect())) and one.count() == 2


def test_features_of_the_spine_months_only(spark):
    ev = _events(spark)
    spine = spark.createDataFrame([(1, "2000-03"), (1, "2001-08"), (2, "2000-04"), (2, None), (None, "2000-04"), (3, "2000-04")],
                                  "actor_id long, cohort_month string")
    wanted = pn.wanted_cohorts(spine, "2000-01")
    assert wanted.count() == 3
    rows = ev.join(wanted, "actor_id")
    for make in (lambda e: fe.share_map(e, fp.NAMED, fp.GROUPS, "2000-01", "2001-08", dense=False),
                 lambda e: fe.class_breadth_lookback(e, fp.CLASSES, "2000-01", "2001-08", dense=False),
                 lambda e: fe.own_use(e, "Brand#12", "2000-01", "2001-08")):
        got, whole = make(rows), make(ev).join(spine, ["actor_id", "cohort_month"], "left_semi")
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(got.columns).collect())) != []
    affl = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 8, 1)], "actor_id long, org_id long, org_rank int")
    peer = [fe.peer_use_flag(ev, affl, "Brand#12", "2000-01", "2001-08", actors=a) for a in (wanted, spine.select("actor_id").distinct())]
    assert sorted(map(str, peer[0].collect())) == sorted(map(str, peer[1].join(spine, ["actor_id", "cohort_month"], "left_semi")
                                                             .select(peer[0].columns).collect())) != []
    # a month far behind the last bit is no month of the spine
    assert pn.cohorts_of(rows.withColumn("month", F.lit("2024-01")), "month", 0, "2024-01", "2024-12").count() == 0


def test_channels_of_the_spine_months_only(spark):
    log = spark.createDataFrame([("1", "20000110", "click", 1, 1, 0, 1), ("2", "20000110", "click", 1, 0, 1, 1), ("9", "20000110", "view", 1, 0, 1, 1)],
                                "actor_key string, date_key string, channel string, exposures long, light long, deep long, total long")
    spine = spark.createDataFrame([(1, "2000-03"), (2, "2001-08"), (2, "2000-12")], "actor_id long, cohort_month string")

    def rows(known):
        return fe.channel_map_rows(log, known, fp.CHANNELS, "2000-01", "2001-08")

    got = rows(pn.wanted_cohorts(spine, "2000-01"))
    whole = rows(spine.select("actor_id")).join(spine.withColumn("actor_id", F.col("actor_id").cast("string")), ["actor_id", "cohort_month"], "left_semi")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(got.columns).collect())) and got.count() == 2


def test_statistics_of_many_columns_in_several_aggregates(spark):
    names = [f"c{i}" for i in range(60)]
    df = spark.range(20).select(*[(F.col("id") * i + F.rand(i)).alias(c) for i, c in enumerate(names)], F.col("id").alias("k")).localCheckpoint()
    stats = pr.fit_scaler(df, names)
    groups = [line.count("stddev_pop(") for line in stats._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert len(groups) == 3 and max(groups) <= pr.STATS_COLUMNS
    want = df.agg(*[f(c) for c in names for f in (F.avg, F.stddev_pop)]).first()
    assert stats.columns == [f"{c}__{x}" for c in names for x in ("mean", "std")] and tuple(stats.first()) == pytest.approx(tuple(want), rel=1e-12)
