"""Mixing sources to target weights by capped water-filling.

Targets: the budget is dealt by weight; a source whose share exceeds
``max_epochs`` times its size stops there and its excess is dealt again by
weight until none is above.  The result is ``min(cap, level * weight)`` for
one water level, found from sums over the sources sorted by cap / weight.

Repetitions: ``r = target / size`` of a source is taken as ``floor(r)`` whole
repetitions of each document and, for the rest, the documents first in a
seeded order while the sum stays within the target, and the one later document
whose size comes nearest to what is then missing.  The last place is found by summing sizes in 1024 buckets of the order, then 1024
buckets inside the decisive one, then single documents inside the last, so no
task sees more than a millionth of a hot source's rows in one window.  What
remains is one row for each source, by which any copy of the documents can be
mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import prepare, staged, text_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Bits of a document's place in the seeded order, and of one level of buckets.
PLACE_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def seeded_place(doc_id: Column, text: Column, seed: int) -> Column:
    """The document's place in the seeded order, from its id and text."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text))
    return F.conv(F.substring(mark, 1, PLACE_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> weight and target beside them.  The table has one row for each source."""
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = (sources.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", weight)
              .withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight")))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).over(everything)
    ranked = ranked.withColumn("chosen", level["level"])
    target = F.when(F.col("chosen").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("chosen") * F.col("weight")))
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *keep: Column) -> DataFrame:
    text = text_of(docs, text_col)
    return docs.select(*keep, docs[source_col].cast("string").alias("source"),
                       word_count(text).alias("size"), seeded_place(docs[id_col], text, seed).alias("place"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mixing_plan(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size, place) of all documents -> for each source its target, whole repetitions, the last place
    that gets one more, and the place of one more document that does."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sources, weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = staged(goal, "mixing-goal")

    # (prefix of the place, words still to take) of each source, one level of buckets deeper each time
    cut = goal.where("rest > 0").select("source", F.lit(0).cast("long").alias("prefix"), "rest")
    bits = 0
    for _ in range(2):
        bits += LEVEL_BITS
        c = cut.select(F.col("source").alias("s"), "prefix", "rest")
        inside = sized.join(c, _same(F.col("source"), F.col("s"))
                            & (F.shiftright("place", PLACE_BITS - bits + LEVEL_BITS) == F.col("prefix")))
        sums = (inside.groupBy("source", F.shiftright("place", PLACE_BITS - bits).alias("bucket"))
                .agg(F.sum("size").alias("size"), F.first("rest").alias("rest")))
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("up_to", F.sum("size").over(order))
        found = sums.where("up_to >= rest").groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("rest") - F.col("up_to") + F.col("size")).alias("rest"))).alias("m"))
        cut = staged(found.select("source", F.col("m.bucket").alias("prefix"), F.col("m.rest").alias("rest")), "mixing-cut")
    c = cut.select(F.col("source").alias("s"), "prefix", "rest")
    inside = sized.join(c, _same(F.col("source"), F.col("s")) & (F.shiftright("place", PLACE_BITS - bits) == F.col("prefix")))
    same_place = inside.groupBy("source", "place").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"),
                                                       F.first("prefix").alias("prefix"))
    up_to = F.sum("size").over(Window.partitionBy("source").orderBy("place"))
    taken = same_place.withColumn("up_to", up_to).where("up_to <= rest")
    last = taken.groupBy("source").agg(F.max(F.struct("place", F.col("rest") - F.col("up_to"))).alias("m"))
    c = c.join(last, _same(F.col("s"), F.col("source")), "left").select(
        "s", F.coalesce("m.place", F.shiftleft("prefix", PLACE_BITS - bits) - 1).alias("last"),
        F.coalesce("m.col2", "rest").alias("missing"))
    later = sized.join(c, _same(F.col("source"), F.col("s")) & (F.col("place") > F.col("last")))
    off = F.abs(F.col("size") - F.col("missing"))
    filler = later.where(off < F.col("missing")).groupBy("source").agg(F.min(F.struct(off, "place"))["place"].alias("filler"))
    filler = filler.withColumnRenamed("source", "f")
    plan = goal.join(c, _same(F.col("source"), F.col("s")), "left").join(filler, _same(F.col("source"), F.col("f")), "left")
    return staged(plan.select(
        F.col("source").alias("plan_source"), "source_size", "target", "whole",
        F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("filler", F.lit(-1)).alias("filler")), "mixing-plan")


def mix_sources(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document.

    Returns ``row`` (a struct of the kept columns, all by default), source,
    size, source_size, target, times and taken.  The size is the number of
    words; a null or blank text has none and is taken as often as its source
    is.  A null source is a source of its own, last in order.  Rows with equal
    id and text share one place in the order and are taken alike.  Sizes that
    are all 0 give targets of 0.  Other columns of ``docs`` stay inside
    ``row``.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    slim = staged(_sized(docs, id_col, text_col, source_col, seed), "mixing-sizes")
    plan = mixing_plan(slim, weights, max_epochs)
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row")
    sized = _sized(docs, id_col, text_col, source_col, seed, row)
    times = (F.col("whole") + F.when((F.col("place") <= F.col("last")) | (F.col("place") == F.col("filler")), 1).otherwise(0)).cast("long")
    # the plan was written, so its size is known: it is broadcast only below Spark's threshold
    return sized.join(plan, _same(F.col("source"), F.col("plan_source"))).select(
        "row", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))
