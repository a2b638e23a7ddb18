"""Order statistics by ranges, two-level distinct counts, long to wide, string date windows, shapes."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortkit.functions.dates import parse_date, string_date_window
from cohortkit.operators import distinct as di
from cohortkit.operators import quality as qa
from cohortkit.operators import ranges as rg
from cohortkit.operators import shape as sh
from cohortkit.sources.tables import describe_table

SF = "/root/testdata/sf0.001"
PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@pytest.mark.parametrize("n, values", [(1, 1), (2, 2), (997, 40), (5000, 5000), (3000, 1)])
def test_quantiles_equal_numpy(spark, n, values):
    rnd = random.Random(n)
    data = [float(rnd.randrange(values)) if values > 1 else 3.0 for _ in range(n)]
    frame = spark.createDataFrame([(x,) for x in data] + [(None,)], "v double").repartition(7)
    got = rg.quantiles(frame, "v", PROBS).first()
    assert np.allclose([got[rg.quantile_name(p)] for p in PROBS], np.quantile(data, PROBS))


def test_quantiles_of_groups_and_of_nothing(spark):
    rnd = random.Random(5)
    data = {g: [rnd.gauss(0, 1) for _ in range(m)] for g, m in (("a", 1), ("b", 700), ("hot", 4000))}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): (r["n"], r["quantile"]) for r in rg.quantiles_long(frame, "g", "v", PROBS).collect()}
    assert set(got) == {(g, p) for g in data for p in PROBS}
    for (g, p), (n, q) in got.items():
        assert n == len(data[g]) and abs(q - np.quantile(data[g], p)) < 1e-9
    assert rg.quantiles(frame.where("g = 'none'"), "v", (0.5,)).first()[0] is None
    plan = rg.quantiles(frame, "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_quantile_windows_hold_one_range(spark):
    """The rows of a range are a share of all, so no window holds the whole table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = rg.deal_ranges(spark.range(20_000), "id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in dealt.groupBy(rg.RANGE).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000
    first = dealt.groupBy(rg.RANGE).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy(rg.RANGE).collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(first, first[1:]))


def test_running_totals(spark):
    frame = spark.createDataFrame([(i, i % 7) for i in range(500)], "k long, x long").repartition(5)
    got = {r["k"]: (r["x_upto"], r["x_total"]) for r in rg.running_totals(frame, F.desc("k"), ["x"]).collect()}
    total = sum(i % 7 for i in range(500))
    assert got == {i: (sum(j % 7 for j in range(i, 500)), total) for i in range(500)}


def test_approximate_quantiles_keep_their_rank(spark):
    rnd = random.Random(8)
    frame = spark.createDataFrame([(rnd.paretovariate(1),) for _ in range(3000)], "v double").repartition(6)
    errors = rg.rank_errors(frame, "v", rg.approx_quantiles(frame, "v", PROBS, 0.01)).collect()
    assert len(errors) == len(PROBS) and all(r["rank_error"] <= 0.01 and r["n"] == 3000 for r in errors)
    wrong = spark.createDataFrame([(0.5, 1e9)], "prob double, quantile double")
    assert rg.rank_errors(frame, "v", wrong).first()["rank_error"] == 0.5


def test_distinct_by_kind_beyond_one_word(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, *range(30)]), rnd.randrange(100), rnd.random()) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "k int, id int, c int, x double")
    kinds = {f"n{c}": F.when(F.col("c") == c, True) for c in range(100)}
    got = di.distinct_by_kind(frame, ["k"], "id", kinds, {"low": (F.min, F.col("x")), "rows": (F.sum, F.lit(1))})
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        mine = [x for x in rows if x[0] == r["k"]]
        assert r["rows"] == len(mine) and r["low"] == min(x[3] for x in mine)
        for c in range(100):
            assert r[f"n{c}"] == len({x[1] for x in mine if x[2] == c and x[1] is not None})
    none = di.distinct_by_kind(frame.where("false"), [], "id", {"n": F.lit(True)}).collect()
    assert [r["n"] for r in none] == [0]


def test_distinct_each(spark):
    rows = [(1, "a", None), (1, "a", 2), (2, None, None), (None, "b", 3), (None, "c", 3)]
    frame = spark.createDataFrame(rows, "k int, s string, t int")
    got = {r["k"]: (r["s_n"], r["t_n"]) for r in di.distinct_each(frame, ["k"], {"s_n": "s", "t_n": "t"}).collect()}
    assert got == {1: (1, 1), 2: (0, 0), None: (2, 1)}
    assert tuple(di.distinct_each(frame, [], {"s_n": "s", "t_n": "t"}).first()) == (3, 2)


@pytest.mark.skipif(not entry.os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", [
    "market_overview", "subjects_by_product_use", "class_breadth_trailing", "trailing_share", "age_band_counts",
    "actor_characteristics", "source_match_coverage", "distinct_counts", "entity_confusion", "id_coverage", "actor_classes",
    "lookback_counts", "product_reach", "dimension_coverage"])
def test_no_row_is_copied_for_distinct_counts(spark, name):
    assert "Expand" not in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not entry.os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["classification_metrics", "pr_curve", "average_precision"])
def test_rank_metrics_read_written_counts(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "ranges" in plan


@pytest.mark.parametrize("columns", [1, 10_000])
def test_long_to_wide(spark, monkeypatch, columns):
    """One conditional aggregate, and the lookup used for many columns, give the same."""
    monkeypatch.setattr(sh, "CONDITIONAL_COLUMNS", columns)
    rows = [(1, "x", 2.0, 5), (1, "y", 3.0, None), (1, "x", 4.0, 1), (2, None, 9.0, 9), (3, "z-1", None, 2)]
    frame = spark.createDataFrame(rows, "id int, c string, q double, n int")
    wide = sh.long_to_wide(frame, "id", "c", ["q", "n"], agg="sum")
    assert wide.columns == ["id", "x_q", "x_n", "y_q", "y_n", "z_1_q", "z_1_n"]
    assert {tuple(r) for r in wide.collect()} == {(1, 6.0, 6, 3.0, None, None, None), (2, *[None] * 6), (3, None, None, None, None, None, 2)}
    filled = sh.long_to_wide(frame, ["id"], "c", "q", ["x", "absent"], agg="sum", prefix="Q", fill=0)
    assert {tuple(r) for r in filled.collect()} == {(1, 6.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)}
    assert {tuple(r) for r in sh.long_to_wide(frame, "id", "c", "n", ["x", "y"], agg="count").collect()} == {(1, 2, 0), (2, 0, 0), (3, 0, 0)}


def test_categories_overflow_names_the_column(spark):
    frame = spark.range(30).withColumn("code", F.col("id").cast("string"))
    assert len(sh.categories(frame, "code", 30)) == 30
    with pytest.raises(ValueError, match="code"):
        sh.categories(frame, "code", 29)
    clash = spark.createDataFrame([(1, "a-b", 1), (1, "a_b", 2)], "id int, c string, v int")
    with pytest.raises(ValueError, match="c:"):
        sh.long_to_wide(clash, "id", "c", "v")


@pytest.mark.parametrize("fmt, shape", [("yyyyMMdd", "%Y%m%d"), ("MMddyyyy", "%m%d%Y"), ("yyyy-MM-dd", "%Y-%m-%d"),
                                        ("dd/MM/yyyy", "%d/%m/%Y"), ("yyyyDDD", "%Y%j")])
def test_string_window_equals_parsed_filter(spark, tmp_path, fmt, shape):
    days = [dt.date(2023, 12, 25) + dt.timedelta(k) for k in range(450)]
    texts = [d.strftime(shape) for d in days] + ["", " ", "x", "20240230", "2024", "99999999", "02302024", "2024-1-5", " 20240105", None,
                                                 "20240105x", "01052024 ", "0105024"]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(t,) for t in texts], "d string").write.parquet(path)
    table = spark.read.parquet(path)
    for start, end in (("2024-01-05", "2024-01-05"), ("2023-12-30", "2025-01-02"), ("2024-03-01", "2024-02-01")):
        exact = table.where(parse_date("d", fmt).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        windowed = table.where(string_date_window("d", fmt, start, end))
        assert sorted(r[0] for r in windowed.collect()) == sorted(r[0] for r in exact.collect())
    plan = table.where(string_date_window("d", fmt, "2024-01-05", "2024-03-05"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    if fmt.startswith("yyyyMM") or fmt == "yyyy-MM-dd":
        assert "GreaterThanOrEqual(d,2024" in pushed and "LessThanOrEqual(d,2024" in pushed
    elif fmt != "yyyyDDD":
        assert "StringEndsWith(d,2024)" in pushed


def test_describe_table_and_null_columns(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, None, None)], "a int, b string, `c d` string")
    assert [tuple(r) for r in describe_table(frame).orderBy("position").collect()] == [
        (1, "a", "int", 2, 2), (2, "b", "string", 2, 0), (3, "c d", "string", 2, 1)]
    assert qa.select_non_null_columns(frame.withColumnRenamed("c d", "c")).columns == ["a", "c"]
