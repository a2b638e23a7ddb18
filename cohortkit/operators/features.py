"""Actor feature operators.

Every cohort-month feature uses ``panel.cohorts_of``: an event in month
m informs only the <= 12 cohort months c with 0 < (c - lag) - m <= 12, so the
fan-out is bounded by 12x and never joins all history to all cohort months.
Distinct counts per (actor, cohort, bucket) are then plain grouped
aggregates (partial aggregation before the shuffle).  Cohort and bucket stay
integers up to the last aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.dates import month_index_of_str
from cohortkit.functions.exprs import any_true, listed_class, recode_use
from cohortkit.operators.distinct import distinct_by_kind
from cohortkit.operators.panel import COHORT, EDGE, WANTED, bucket_name, carried, cohort_month, cohorts_of, densify_ids, is_wanted
from cohortkit.operators.shape import col_name, long_to_wide

# Fixed values of the reference's specialty rule (codes, their groups and the
# substrings that mark internal medicine).
SPECIALTY_CODES = {"HEM": "HEMATOLOGY", "HEP": "HEMATOLOGY", "HO": "HEM/ONC", "ON": "HEM/ONC",
                   "PHO": "PEDIATRIC_HEM/ONC"}
INTERNAL_MEDICINE_PARTS = ("GP", "FM", "PD", "IM")

# Age bands (inclusive edges) of the reference.
AGE_BANDS = (("PAT_AGE_0_11", None, 11), ("PAT_AGE_12_17", 12, 17), ("PAT_AGE_18_24", 18, 24),
             ("PAT_AGE_25_65", 25, 65), ("PAT_AGE_65+", 66, None))


def product_use_rows(events: DataFrame, named, groups) -> DataFrame:
    """D27 steps 1-3: distinct (actor, month, product_use, subject) for named
    products and product groups, in one projection and one distinct.

    use = '1' when null or UNK; named products -> '<product>_<use>', grouped
    products -> '<group>_<use>'; other products dropped.
    """
    use = recode_use("use_flag", unknown_as="1")
    code = None
    for p in named:
        cond = F.col("product") == F.lit(p)
        code = F.when(cond, F.lit(p)) if code is None else code.when(cond, F.lit(p))
    for gname, members in groups:
        cond = F.col("product").isin(list(members))
        code = F.when(cond, F.lit(gname)) if code is None else code.when(cond, F.lit(gname))
    return (events.select("actor_id", "month", F.concat_ws("_", code, use).alias("product_use"), "subject_id",
                          code.alias("_code"))
                  .filter(F.col("_code").isNotNull()).drop("_code").distinct())


def product_use_actors(events: DataFrame, named, groups) -> DataFrame:
    """Actors with an event of a named or grouped product."""
    listed = [*named, *(p for _, members in groups for p in members)]
    return events.filter(F.col("product").isin(listed)).select("actor_id").distinct()


def product_use_values(named, groups, uses=("0", "1")):
    return [f"{p}_{u}" for p in named for u in uses] + [f"{g}_{u}" for g, _ in groups for u in uses]


def share_by_product_use(events: DataFrame, named, groups, cohort_lo: str, cohort_hi: str,
                         lag: int = 2, edges=(1, 3, 6, 9, 12)) -> DataFrame:
    """D27 (long): share = distinct subjects of (product_use, bucket) / distinct
    subjects of the bucket, per actor and cohort month."""
    rows = product_use_rows(events, named, groups)
    fan = cohorts_of(rows, "month", lag, cohort_lo, cohort_hi, edges)
    keys = ["actor_id", COHORT, EDGE]
    num = fan.groupBy(*keys, "product_use").agg(F.countDistinct("subject_id").alias("n_subjects"))
    den = fan.groupBy(*keys).agg(F.countDistinct("subject_id").alias("row_total"))
    return num.join(den, keys).select("actor_id", cohort_month(), bucket_name(), "product_use", "n_subjects", "row_total",
                                      (F.col("n_subjects") / F.col("row_total")).alias("share"))


#: Product x use codes in one long bit mask.
MASK_BITS = 62


def _use_bits(named, groups) -> list[list]:
    """Mask expressions, one for each 62 product x use codes: the bit of a row's product (group) and use."""
    use = recode_use("use_flag", unknown_as="1")
    position = {v: i for i, v in enumerate(product_use_values(named, groups))}
    members = [(p, F.col("product") == F.lit(p)) for p in named] + [(g, F.col("product").isin(list(m))) for g, m in groups]
    masks = []
    for first in range(0, len(position), MASK_BITS):
        mask = None
        for name, cond in members:
            bits = F.lit(0).cast("long")
            for u in ("0", "1"):
                at = position[f"{name}_{u}"] - first
                if 0 <= at < MASK_BITS:
                    bits = F.when(use == u, F.lit(1 << at).cast("long")).otherwise(bits)
            mask = F.when(cond, bits) if mask is None else mask.when(cond, bits)
        masks.append(mask)
    return masks


def share_wide(events: DataFrame, named, groups, cohort_lo: str, cohort_hi: str, lag: int = 2,
               edges=(1, 3, 6, 9, 12), ids: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """D27 (wide): SHARE_<product_use>_<bucket>, 0-filled; dense over actors x cohort months, or the keys with events only.

    Each product_use code is a bit; rows are dealt by actor once and reduced to one bit mask per
    (actor, month, subject) with ``bit_or`` before the 12x cohort fan-out and
    to one mask per (actor, cohort, bucket, subject) after it — fixed-width
    hash aggregates, no distinct-count shuffles, no join of numerator and
    denominator, no pivot.  Bits are then summed per bucket, and only the few
    bucket rows of a key are laid side by side.
    """
    wide = share_map(events, named, groups, cohort_lo, cohort_hi, lag, edges, ids, dense)
    return wide.select("actor_id", "cohort_month", *share_columns(named, groups, edges))


def share_columns(named, groups, edges=(1, 3, 6, 9, 12)) -> list:
    """The columns of ``share_wide`` from the map of ``share_map``."""
    return [F.coalesce(F.get(F.try_element_at("_shares", F.lit(e)), F.lit(i)), F.lit(0.0)).alias(col_name("SHARE", f"{v}_LAST_{e}M"))
            for i, v in enumerate(product_use_values(named, groups)) for e in edges]


def share_map(events: DataFrame, named, groups, cohort_lo: str, cohort_hi: str, lag: int = 2,
              edges=(1, 3, 6, 9, 12), ids: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """The rows of ``share_wide`` with one column ``_shares``: the array of shares by bucket edge, for the edges with events.

    Joins carry this map and lay it out last, so that no wide row is shuffled.
    Events with a ``panel.WANTED`` column give the cohort months named there only.
    """
    values = product_use_values(named, groups)
    masks = _use_bits(named, groups)
    names = [f"_mask_{k}" for k in range(len(masks))]
    listed = [*named, *(p for _, members in groups for p in members)]
    rows = events.filter(F.col("product").isin(listed) & F.col("subject_id").isNotNull())
    per_month = rows.repartition("actor_id").groupBy("actor_id", *carried(events), "month", "subject_id").agg(*[F.bit_or(m).alias(n) for m, n in zip(masks, names)])
    fan = cohorts_of(per_month, "month", lag, cohort_lo, cohort_hi, edges)
    per = fan.groupBy("actor_id", COHORT, EDGE, "subject_id").agg(*[F.bit_or(n).alias(n) for n in names])
    bit = [F.shiftright(F.col(names[i // MASK_BITS]), i % MASK_BITS).bitwiseAND(F.lit(1)) for i in range(len(values))]
    sums = per.groupBy("actor_id", COHORT, EDGE).agg(F.count(F.lit(1)).alias("_all"), *[F.sum(b).alias(f"_n_{i}") for i, b in enumerate(bit)])
    # the buckets of a key, a few rows, as one map: an aggregate with a buffer for each column would not be compiled
    row = F.array(*[F.col(f"_n_{i}") / F.col("_all") for i in range(len(values))])
    wide = sums.groupBy("actor_id", COHORT).agg(F.map_from_entries(F.collect_list(F.struct(F.col(EDGE), row))).alias("_shares"))
    if dense:
        ids = product_use_actors(events, named, groups) if ids is None else ids
        grid = densify_ids(ids, "actor_id", COHORT, month_index_of_str(F.lit(cohort_lo)), month_index_of_str(F.lit(cohort_hi)))
        wide = grid.join(wide, ["actor_id", COHORT], "left")
    return wide.select("actor_id", cohort_month(), "_shares")


def subjects_by_product_use(events: DataFrame, named, groups) -> DataFrame:
    """Monthly distinct subjects per (actor, product_use), wide."""
    rows = product_use_rows(events, named, groups)  # distinct, so each row is one subject of its product_use
    per = rows.groupBy("actor_id", "month", "product_use").agg(F.count("subject_id").alias("n"))
    return long_to_wide(per, ["actor_id", "month"], "product_use", "n", product_use_values(named, groups), agg="sum",
                        prefix="N", fill=0)


def org_flag(events: DataFrame, org_col: str = "institution") -> DataFrame:
    """(actor, month) with an institution -> flag 1."""
    return (events.filter(F.col(org_col).isNotNull())
                  .select("actor_id", "month", F.lit(1).alias("org_flag")).distinct())


def org_size(affl: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """Distinct actors per organisation over main (rank-1) affiliations."""
    a = affl.filter(F.col("org_rank") == 1)
    if actors is not None:
        a = a.join(actors.select("actor_id").distinct(), "actor_id", "left_semi")
    return a.groupBy("org_id").agg(F.countDistinct("actor_id").alias("account_size"))


def org_degree(affl: DataFrame) -> DataFrame:
    """Organisations per actor (all affiliations)."""
    return affl.groupBy("actor_id").agg(F.countDistinct("org_id").alias("n_orgs"))


def org_members(affl: DataFrame) -> DataFrame:
    """Actors per organisation (all affiliations)."""
    return affl.groupBy("org_id").agg(F.countDistinct("actor_id").alias("n_actors"))


def peer_use_flag(events: DataFrame, affl: DataFrame, product: str, cohort_lo: str, cohort_hi: str,
                  lag: int = 2, horizon: int = 12, actors: DataFrame | None = None) -> DataFrame:
    """Actor flagged for a cohort month when its main organisation had a
    user of ``product`` in the ``horizon`` months before (cohort - lag).  The
    actor counts as its own peer.  ``actors`` limits the actors that are
    flagged, not those that count as peers; their ``panel.WANTED`` months, where
    named, limit the cohort months.

    The org-level table has at most (#orgs x #cohort months) rows, so the
    final org -> actors join is against an aggregate, never against events.
    """
    main = affl.filter(F.col("org_rank") == 1).select("actor_id", "org_id")
    org_months = (events.filter(F.col("product") == product).select("actor_id", "month")
                        .join(main, "actor_id").select("org_id", "month").distinct())
    org_cohorts = cohorts_of(org_months, "month", lag, cohort_lo, cohort_hi, (horizon,)).select("org_id", COHORT).distinct()
    if actors is not None and carried(actors):
        flagged = org_cohorts.join(main.join(actors.select("actor_id", WANTED), "actor_id"), "org_id").filter(is_wanted(F.col(COHORT)))
    else:
        members = main if actors is None else main.join(actors, "actor_id", "left_semi")
        flagged = org_cohorts.join(members, "org_id")
    return flagged.select("actor_id", cohort_month(), F.lit(1).alias("peer_flag"), "org_id")


def own_use_flag(events: DataFrame, affl: DataFrame, product: str, cohort_lo: str, cohort_hi: str,
                 lag: int = 2, horizon: int = 12) -> DataFrame:
    """Every main-affiliated actor x cohort month, 1 when the actor itself
    used ``product`` in the ``horizon`` months before (cohort - lag), else 0."""
    main = affl.filter(F.col("org_rank") == 1).select("actor_id").distinct()
    hit = own_use(events, product, cohort_lo, cohort_hi, lag, horizon)
    grid = densify_ids(main, "actor_id", COHORT, month_index_of_str(F.lit(cohort_lo)), month_index_of_str(F.lit(cohort_hi)))
    return (grid.select("actor_id", cohort_month()).join(hit, ["actor_id", "cohort_month"], "left").fillna(0, ["own_flag"]))


def own_use(events: DataFrame, product: str, cohort_lo: str, cohort_hi: str, lag: int = 2, horizon: int = 12) -> DataFrame:
    """D32, only the actors and cohort months with use."""
    used = events.filter(F.col("product") == product).select("actor_id", *carried(events), "month").distinct()
    hits = cohorts_of(used, "month", lag, cohort_lo, cohort_hi, (horizon,)).select("actor_id", COHORT).distinct()
    return hits.select("actor_id", cohort_month(), F.lit(1).alias("own_flag"))


def specialty_group(profile: DataFrame, code_cols=("code1", "code2", "code3"),
                    codes: dict | None = None, fallback_parts=INTERNAL_MEDICINE_PARTS,
                    fallback_group: str = "INTERNAL_MEDICINE", other: str = "OTHERS") -> DataFrame:
    """First code in the accepted list -> its group; otherwise, if the
    '|'-joined codes contain a fallback part -> fallback group; else OTHERS.
    Missing codes are 'NA'.  Substring test, as in the reference."""
    codes = SPECIALTY_CODES if codes is None else codes
    filled = profile.fillna("NA", list(code_cols))
    acc = list(codes)
    first = None
    for c in code_cols:
        cond = F.col(c).isin(acc)
        first = F.when(cond, F.col(c)) if first is None else first.when(cond, F.col(c))
    grp = None
    for code, g in codes.items():
        cond = first == F.lit(code)
        grp = F.when(cond, F.lit(g)) if grp is None else grp.when(cond, F.lit(g))
    joined = F.concat_ws("|", *[F.col(c) for c in code_cols])
    fb = F.when(any_true(joined.contains(p) for p in fallback_parts), F.lit(fallback_group)).otherwise(F.lit(other))
    return filled.select("actor_id", F.coalesce(grp, fb).alias("specialty"))


def age_band(age) -> F.Column:
    expr = None
    for name, lo, hi in AGE_BANDS:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (age >= lo)
        if hi is not None:
            cond = cond & (age <= hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.when(age.isNull(), F.lit("PAT_AGE_NA")).otherwise(expr)


def age_band_counts(events: DataFrame, year_start: str, year_end: str, as_of: str,
                    birth_year_col: str = "birth_year") -> DataFrame:
    """age = ceil(days(as_of - Jan 1 of birth year) / 365); distinct subjects
    per band per actor in the reference year, wide, 0-filled."""
    bd = F.make_date(F.col(birth_year_col), F.lit(1), F.lit(1))
    age = F.ceil(F.datediff(F.to_date(F.lit(as_of)), bd) / 365)
    ev = (events.filter((F.col("event_date") >= F.to_date(F.lit(year_start)))
                        & (F.col("event_date") <= F.to_date(F.lit(year_end))))
                .withColumn("band", age_band(age)))
    names = [b[0] for b in AGE_BANDS] + ["PAT_AGE_NA"]
    return distinct_by_kind(ev, ["actor_id"], "subject_id", {f"{n}_CNT": F.col("band") == n for n in names})


def subject_counts(events: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct subjects per actor in [start, end] (dates)."""
    return (events.filter((F.col("event_date") >= F.to_date(F.lit(start)))
                          & (F.col("event_date") <= F.to_date(F.lit(end))))
                  .groupBy("actor_id").agg(F.countDistinct("subject_id").alias("n_subjects")))


def actor_characteristics(counts: DataFrame, ages: DataFrame, specialty: DataFrame,
                          affl: DataFrame, sizes: DataFrame) -> DataFrame:
    """Counts ⟗ age bands (NA dropped) ⟕ specialty ⟕ main org ⟕ org size."""
    main = affl.filter(F.col("org_rank") == 1).select("actor_id", "org_id")
    return (counts.join(ages.drop("PAT_AGE_NA_CNT"), "actor_id", "full")
                  .join(specialty, "actor_id", "left")
                  .join(main, "actor_id", "left")
                  .join(sizes, "org_id", "left"))


def channel_engagement(channel: DataFrame, known_actors: DataFrame, channel_map: dict,
                       cohort_lo: str, cohort_hi: str, lag: int = 0, edges=(1, 3, 6, 9, 12),
                       measures=("exposures", "light", "deep", "total")) -> DataFrame:
    """Valid and known actors; channels recoded and limited to the map's
    keys (filtered before aggregating); four measures summed per actor x month
    x channel; recency buckets (lag 0); wide ``<CHANNEL>_<bucket>_<measure>``.
    Actor-cohort keys with no event in the window are absent."""
    wide = channel_map_rows(channel, known_actors, channel_map, cohort_lo, cohort_hi, lag, edges, measures)
    return wide.select("actor_id", "cohort_month", *channel_columns(channel_map, edges, measures))


def channel_columns(channel_map: dict, edges=(1, 3, 6, 9, 12), measures=("exposures", "light", "deep", "total")) -> list:
    """The columns of ``channel_engagement`` from the map of ``channel_map_rows``."""
    vals = [f"{c}_LAST_{e}M" for c in dict.fromkeys(channel_map.values()) for e in edges]
    return [F.coalesce(F.try_element_at("_channels", F.lit(v))[m], F.lit(0)).alias(col_name(v, m)) for v in vals for m in measures]


def channel_map_rows(channel: DataFrame, known_actors: DataFrame, channel_map: dict,
                     cohort_lo: str, cohort_hi: str, lag: int = 0, edges=(1, 3, 6, 9, 12),
                     measures=("exposures", "light", "deep", "total")) -> DataFrame:
    """The rows of ``channel_engagement`` with one column ``_channels``: the measures by channel and bucket;
    in the ``panel.WANTED`` months of the known actors only, where named (one row for each actor then)."""
    from cohortkit.functions.dates import month_str, parse_date

    valid = channel.filter(F.col("actor_key").isNotNull() & (F.col("actor_key") != "-1")
                           & F.col("channel").isin(*channel_map))
    key = F.col("actor_id").cast("string").alias("actor_key")
    carry = carried(known_actors)
    known = (valid.join(known_actors.select(key, *carry), "actor_key") if carry else
             valid.join(known_actors.select(key).distinct(), "actor_key", "left_semi"))
    recode = None
    for k, v in channel_map.items():
        cond = F.col("channel") == F.lit(k)
        recode = F.when(cond, F.lit(v)) if recode is None else recode.when(cond, F.lit(v))
    ev = (known.withColumn("ch", recode).filter(F.col("ch").isNotNull())
               .withColumn("month", month_str(parse_date("date_key", "yyyyMMdd"))))
    monthly = ev.groupBy("actor_key", *carry, "month", "ch").agg(*[F.sum(m).alias(m) for m in measures])
    fan = cohorts_of(monthly, "month", lag, cohort_lo, cohort_hi, edges)
    per = fan.groupBy("actor_key", COHORT, "ch", EDGE).agg(*[F.sum(m).alias(m) for m in measures])
    per = per.select(F.col("actor_key").alias("actor_id"), COHORT, F.concat_ws("_", "ch", bucket_name()).alias("_k"), *measures)
    wide = per.groupBy("actor_id", COHORT).agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct(*measures)))).alias("_channels"))
    return wide.select("actor_id", cohort_month(), "_channels")


def subject_quantity(events: DataFrame, keys=("subject_id",)) -> DataFrame:
    """Quantity per subject (or other keys) and month."""
    return events.groupBy(*keys, "month").agg(F.sum("quantity").alias("quantity"))


def subject_quantity_wide(events: DataFrame, products) -> DataFrame:
    """Quantity per subject-month by product x use (use '0' stays 0, else 1), wide."""
    use = recode_use("use_flag", unknown_as="binary")
    ev = events.withColumn("_k", F.concat_ws("_", "product", use))
    vals = [f"{p}_{u}" for p in products for u in ("0", "1")]
    return long_to_wide(ev, ["subject_id", "month"], "_k", "quantity", vals, agg="sum", prefix="QTY", fill=0)


def class_breadth_lookback(events: DataFrame, classes, cohort_lo: str, cohort_hi: str,
                           lag: int = 0, horizon: int = 12, ids: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """Per class, the sum of monthly distinct products over the months with
    gap in (0, horizon] before the cohort month; wide, 0-filled; dense over actors x cohort months, or the keys with
    events only."""
    cls = listed_class("product_group", classes)
    item = F.coalesce(F.col("product"), F.lit("UNKNOWN"))
    names = [col_name("N", c) for c in classes]
    # dealt by actor once, before the fan-out: every later step groups within an actor
    rows = events.select("actor_id", *carried(events), "month", cls.alias("cls"), item.alias("item")).repartition("actor_id")
    by_month = distinct_by_kind(rows, ["actor_id", *carried(events), "month"], "item", {n: F.col("cls") == c for n, c in zip(names, classes)})
    fan = cohorts_of(by_month, "month", lag, cohort_lo, cohort_hi, (horizon,))
    wide = fan.groupBy("actor_id", COHORT).agg(*[F.sum(n).alias(f"{n}_{horizon}M") for n in names])
    if not dense:
        return wide.select("actor_id", cohort_month(), *[f"{n}_{horizon}M" for n in names])
    ids = events.select("actor_id").distinct() if ids is None else ids
    grid = densify_ids(ids, "actor_id", COHORT, month_index_of_str(F.lit(cohort_lo)), month_index_of_str(F.lit(cohort_hi)))
    out = grid.join(wide, ["actor_id", COHORT], "left")
    return out.select("actor_id", cohort_month(), *[F.coalesce(F.col(f"{n}_{horizon}M"), F.lit(0)).alias(f"{n}_{horizon}M") for n in names])
