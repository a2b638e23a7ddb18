"""Role mapping of the provided test tables onto the engine's vocabulary.

The engine's operators speak about an *event log* (actor, subject, date,
product, group, quantity, use flag, source), an *activity log*, a *channel
log*, *affiliations* and an *actor profile*.  These builders derive them from
the TPC-H-ish tables with plain joins so that all work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions.dates import month_str
from cohortkit.sources.tables import date_window, read_table

EVENT_COLUMNS = [
    "actor_id", "subject_id", "event_date", "month", "product", "product_group",
    "quantity", "use_flag", "source", "institution", "birth_year", "birth_year_alt",
    "order_key", "line_number",
]


def event_log(spark: SparkSession, sf_dir: str, start: str | None = None,
              end: str | None = None, product: str | None = None) -> DataFrame:
    """lineitem ⋈ orders ⋈ part as the event log (one row per line).

    ``start`` / ``end`` ('yyyy-MM-dd', inclusive) bound the event date on the
    raw ship-date column, so the window is pushed into the lineitem scan
    and filtered rows never reach the join.  Join strategy is left to
    Catalyst/AQE: at scale lineitem ⋈ orders is a shuffle join on the order
    key and part is broadcast only if AQE measures it under the threshold.
    With ``product`` only its events are built: the lines meet its parts first,
    so that the other lines never reach the shuffle by order.
    """
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus", "l_shipdate"])
    if start or end:
        li = li.filter(date_window(li, "l_shipdate", start, end))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"])
    by_order, by_part = li.l_orderkey == o.o_orderkey, li.l_partkey == p.p_partkey
    if product is None:
        j = li.join(o, by_order).join(p, by_part)
    else:
        j = li.join(p.filter(F.col("p_brand") == product), by_part).join(o, by_order)
    by = F.lit(1940) + (F.col("l_suppkey") * 7) % 80
    return j.select(
        F.col("o_custkey").alias("actor_id"),
        F.col("l_suppkey").alias("subject_id"),
        F.to_date("l_shipdate").alias("event_date"),
        month_str(F.to_date("l_shipdate")).alias("month"),
        F.col("p_brand").alias("product"),
        F.col("p_type").alias("product_group"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "R", "1")
         .otherwise("UNK").alias("use_flag"),
        F.col("l_linestatus").alias("source"),
        F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("institution"),
        by.cast("int").alias("birth_year"),
        F.when(F.col("l_suppkey") % 11 == 0,
               F.lit(1940) + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 80)
         .otherwise(by).cast("int").alias("birth_year_alt"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
    )


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a contact log: actor = user_id, day = to_date(ts)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    return e.select(
        F.col("user_id").alias("actor_id"),
        F.to_date("ts").alias("event_date"),
        F.col("event_type").alias("channel"),
        F.col("value"),
        F.col("event_id"),
    )


def channel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a channel-engagement log keyed by a ``yyyyMMdd`` string day.

    exposures = 1 per row, light = value < 50, deep = value >= 50,
    total = light + deep.  The string day key is rebuilt from ``ts`` so the
    operator exercises the string-date parse path.
    """
    e = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type", "value"])
    light = (F.col("value") < 50).cast("long")
    deep = (F.col("value") >= 50).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("actor_key"),
        F.date_format("ts", "yyyyMMdd").alias("date_key"),
        F.col("event_type").alias("channel"),
        F.lit(1).cast("long").alias("exposures"),
        light.alias("light"),
        deep.alias("deep"),
        (light + deep).alias("total"),
    )


def affiliations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Actor -> organisation links with a rank (1 = main affiliation).

    Organisations of an actor are the nations of its suppliers; the rank is by
    row count desc, then org key.  The window is per actor over at most one
    row per organisation, so its size is bounded by the organisation count.
    """
    ev = events if events is not None else event_log(spark, sf_dir)
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    from pyspark.sql import Window

    per = (ev.select("actor_id", "subject_id")
             .join(s, F.col("subject_id") == s.s_suppkey)
             .groupBy("actor_id", F.col("s_nationkey").alias("org_id"))
             .agg(F.count(F.lit(1)).alias("n_rows")))
    w = Window.partitionBy("actor_id").orderBy(F.desc("n_rows"), F.asc("org_id"))
    return per.withColumn("org_rank", F.row_number().over(w))


def actor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actor profile with three specialty codes.

    code1 = market segment, code2 = region name, code3 = priority of the
    actor's first order (earliest date, then lowest order key).
    """
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    first = (o.groupBy("o_custkey")
              .agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("code3")))
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, n.n_regionkey == r.r_regionkey, "left")
             .join(first, c.c_custkey == first.o_custkey, "left")
             .select(F.col("c_custkey").alias("actor_id"),
                     F.col("c_mktsegment").alias("code1"),
                     F.col("r_name").alias("code2"),
                     F.col("code3")))
