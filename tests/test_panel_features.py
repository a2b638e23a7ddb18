import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortkit.config import StudyConfig
from cohortkit.functions.dates import parse_date_any
from cohortkit.functions.exprs import recode_use
from cohortkit.operators import features as fe
from cohortkit.operators import panel as pn
from event_rows import make_events


def test_recency_buckets_disjoint(spark):
    gaps = [0, 1, 2, 3, 4, 6, 7, 9, 10, 12, 13, -1]
    df = spark.createDataFrame([(g,) for g in gaps], "gap int")
    got = {r["gap"]: r["b"] for r in df.select("gap", pn.bucket_of_gap(F.col("gap")).alias("b")).collect()}
    assert got == {0: None, 1: "LAST_1M", 2: "LAST_3M", 3: "LAST_3M", 4: "LAST_6M", 6: "LAST_6M", 7: "LAST_9M",
                   9: "LAST_9M", 10: "LAST_12M", 12: "LAST_12M", 13: None, -1: None}


@pytest.mark.parametrize("lag", [0, 2])
def test_fan_out_matches_brute_force(spark, lag):
    months = ["2000-01", "2000-06", "2000-11", "2001-03"]
    df = spark.createDataFrame([(m,) for m in months], "month string")
    got = sorted((r["month"], r["cohort_month"], r["month_gap"], r["bucket"])
                 for r in pn.fan_out_cohorts(df, "month", lag, "2000-06", "2001-06").collect())

    def idx(m):
        return int(m[:4]) * 12 + int(m[5:]) - 1

    exp = []
    for m in months:
        for c in range(idx("2000-06"), idx("2001-06") + 1):
            g = c - lag - idx(m)
            if 0 < g <= 12:
                b = next(f"LAST_{e}M" for e in (1, 3, 6, 9, 12) if g <= e)
                exp.append((m, f"{c // 12:04d}-{c % 12 + 1:02d}", g, b))
    assert got == sorted(exp)


def test_dense_panel_keeps_empty_months_and_trailing_start(spark):
    facts = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, 3, 2)], "actor_id long, p int, n long")
    panel = pn.dense_panel(facts, "actor_id", "p", "n", F.lit(0), F.lit(4))
    rows = sorted((r["p"], r["n"]) for r in panel.collect())
    assert rows == [(0, 5), (1, 7), (2, 0), (3, 2), (4, 0)]
    tr = sorted((r["p"], r["prev_01_n"], r["prev_03_n"]) for r in
                pn.trailing_sums(panel, "actor_id", "p", "n", (1, 3)).collect())
    assert tr[:3] == [(0, 0, 0), (1, 5, 5), (2, 7, 12)]


def test_trailing_mean_leading_zero(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(14)], "actor_id long, p int, x double")
    got = sorted((r["p"], r["m"]) for r in df.select(
        "p", pn.trailing_mean_with_leading_zero("x", "actor_id", "p", 12).alias("m")).collect())
    exp = [min(i, 12) / min(i + 1, 12) for i in range(14)]
    assert [round(m, 9) for _, m in got] == [round(e, 9) for e in exp]


def test_rolling_stddev_single_row_null(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 5.0)], "s long, w int, q double")
    got = sorted((r["w"], r["std_4_q"]) for r in pn.rolling_stddev(df, "s", "w", ["q"], 4).collect())
    assert got[0][1] is None and got[1][1] is None and abs(got[2][1] - 2 ** 0.5) < 1e-9


def test_use_recode_modes(spark):
    df = spark.createDataFrame([(None,), ("UNK",), ("0",), ("1",)], "u string")
    r = df.select(recode_use("u", "1").alias("a"), recode_use("u", "0", null_as="1").alias("b"),
                  recode_use("u", "binary").alias("c")).collect()
    assert [x["a"] for x in r] == ["1", "1", "0", "1"]
    assert [x["b"] for x in r] == ["1", "0", "0", "1"]
    assert [x["c"] for x in r] == ["1", "1", "0", "1"]


def test_share_overlap_above_one(spark):
    ev = make_events(spark, [(1, 7, "2001-01-10", "A", "1"), (1, 7, "2001-01-12", "B", "1")])
    long = fe.share_by_product_use(ev, ("A", "B"), (), "2001-02", "2001-02", lag=0)
    shares = {r["product_use"]: r["share"] for r in long.collect()}
    assert shares == {"A_1": 1.0, "B_1": 1.0}
    wide = fe.share_wide(ev, ("A", "B"), (), "2001-02", "2001-02", lag=0).first()
    assert wide["SHARE_A_1_LAST_1M"] == 1.0 and wide["SHARE_B_1_LAST_1M"] == 1.0


def test_two_date_formats(spark):
    df = spark.createDataFrame([("20240229",), ("02292024",), ("bad",)], "s string")
    got = [r[0] for r in df.select(parse_date_any("s")).collect()]
    assert got == [dt.date(2024, 2, 29), dt.date(2024, 2, 29), None]


def test_specialty_rule(spark):
    prof = spark.createDataFrame([(1, "X", "HO", "Y"), (2, "IM", None, None), (3, None, None, None),
                                  (4, "APDX", None, None), (5, "HEM", "PHO", None)],
                                 "actor_id long, code1 string, code2 string, code3 string")
    got = {r["actor_id"]: r["specialty"] for r in fe.specialty_group(prof).collect()}
    assert got == {1: "HEM/ONC", 2: "INTERNAL_MEDICINE", 3: "OTHERS", 4: "INTERNAL_MEDICINE", 5: "HEMATOLOGY"}


def test_age_band_edges(spark):
    ages = [11, 12, 17, 18, 24, 25, 65, 66, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = [r[0] for r in df.select(fe.age_band(F.col("age"))).collect()]
    assert got == ["PAT_AGE_0_11", "PAT_AGE_12_17", "PAT_AGE_12_17", "PAT_AGE_18_24", "PAT_AGE_18_24",
                   "PAT_AGE_25_65", "PAT_AGE_25_65", "PAT_AGE_65+", "PAT_AGE_NA"]


def test_sentinel_ids_dropped(spark):
    ch = spark.createDataFrame([("-1", "20240105", "click", 1, 1, 0, 1), (None, "20240105", "click", 1, 1, 0, 1),
                                ("A1", "20240105", "click", 1, 0, 1, 1)],
                               "actor_key string, date_key string, channel string, exposures long, light long, "
                               "deep long, total long")
    known = spark.createDataFrame([("A1",), ("-1",)], "actor_id string")
    out = fe.channel_engagement(ch, known, {"click": "CLICK"}, "2024-02", "2024-02").collect()
    assert [r["actor_id"] for r in out] == ["A1"]
    assert out[0]["CLICK_LAST_1M_deep"] == 1
