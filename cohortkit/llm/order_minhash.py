"""Document fingerprints by order min-hash, in DataFrame expressions.

A text's units are its words; a text of at most CHARACTER_TEXT characters has
its characters as a second kind of unit, and two such texts are compared by
these, all others by words.  Words that are long or written without spaces
count as the overlapping pieces they are made of.  Every run of UNITS units is
a k-mer, numbered among its equals, so a repeated k-mer counts as often as it
occurs.  One hash deals
the numbered k-mers into BINS bins and ranks them there; from each bin the
TUPLE smallest are taken, put back into text order and hashed together.  A
text moved about keeps its k-mers but not their order, so the signatures
follow edit distance, where plain min-hash follows the set alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import prepare, text_of

BINS_BITS, TUPLE = 6, 2
BINS = 1 << BINS_BITS
CHARACTER_TEXT = 512
#: Units of a k-mer of words, and of characters.
UNITS = {"words": 2, "characters": 5}
#: A word that is longer, or has a character of a script without spaces, is split into pieces of so many characters,
#: each one character on from the one before: two in a row are a k-mer of UNITS["characters"].
LONG_WORD, PIECE = 32, UNITS["characters"] - 1
UNSPACED = "\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{2E80}-\\x{A4CF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}"
#: Bits of a k-mer's place in its text kept beside its rank.
PLACE_BITS = 24
RANK_BITS = 63 - BINS_BITS - PLACE_BITS
#: Ranges of ids that are sorted on their own to find each document's successor.
RANGES = 256


def _kmers(units: Column, n: int) -> Column:
    last = F.greatest(F.size(units) - (n - 1), F.lit(1))
    return F.transform(F.slice(units, 1, last), lambda u, i: F.xxhash64(u, *[F.get(units, i + k) for k in range(1, n)]))


def _words(text: str) -> Column:
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    odd = f"[{UNSPACED}]|[^ \\t-\\r]{{{LONG_WORD + 1}}}"

    def pieces(word):
        chars = F.filter(F.split(word, ""), lambda x: x != "")
        return F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - (PIECE - 1), F.lit(1))),
                           lambda c, i: F.concat_ws("", c, *[F.get(chars, i + k) for k in range(1, PIECE)]))

    return F.when(F.col(text).rlike(odd), F.flatten(F.transform(
        words, lambda w: F.when(w.rlike(odd), pieces(w)).otherwise(F.array(w))))).otherwise(words)


def with_fingerprint(frame: DataFrame, text: str, name: str) -> DataFrame:
    """Add column ``name``: an array of signatures of the text column, by kind of unit and bin.

    The low bits of a signature are its bin, the bit above them is 1 for
    characters; a text has those when it is short enough to.
    """
    units = {"words": _words(text), "characters": F.when(F.length(text) <= CHARACTER_TEXT, F.filter(F.split(text, ""), lambda x: x != ""))
             .otherwise(F.array().cast("array<string>"))}
    for kind, of_kind in units.items():
        frame = _with_signatures(frame.withColumn(f"_{name}_units", of_kind), f"_{name}_units", f"{name}_{kind}", UNITS[kind], kind == "characters")
    both = [f"{name}_{kind}" for kind in units]
    return frame.withColumn(name, F.concat(*both)).drop(*both)


def _with_signatures(frame: DataFrame, u: str, name: str, n_units: int, characters: bool) -> DataFrame:
    """Replace the units by their signatures, column ``name``."""
    h, s, v = (f"_{name}_{x}" for x in ("kmers", "sorted", "ranked"))
    place, low = F.lit((1 << PLACE_BITS) - 1), PLACE_BITS
    frame = frame.withColumn(h, _kmers(F.col(u), n_units)).drop(u)
    # value in the high bits, place in the low ones: one sort brings equal k-mers together in text order
    packed = F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, low), low).bitwiseOR(i.bitwiseAND(place).cast("long")))
    frame = frame.withColumn(s, F.sort_array(packed)).drop(h)
    value = lambda x: F.shiftright(x, low)
    starts = F.filter(F.transform(
        F.zip_with(s, F.concat(F.array(F.lit(None).cast("long")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))),
                   lambda x, before: before.isNull() | (value(x) != value(before))),
        lambda first, i: F.when(first, i)), lambda i: i.isNotNull())
    runs = f"_{name}_runs"
    frame = frame.withColumn(runs, starts)
    number = F.flatten(F.transform(
        F.zip_with(runs, F.concat(F.slice(runs, 2, F.size(runs)), F.array(F.size(s))), lambda a, b: b - a),
        lambda n: F.sequence(F.lit(0), n - 1)))
    rank = lambda x, k: F.xxhash64(value(x), k)
    ranked = F.zip_with(s, number, lambda x, k: F.shiftleft(F.shiftrightunsigned(rank(x, k), 1 + PLACE_BITS), low)
                        .bitwiseOR(x.bitwiseAND(place.cast("long"))))
    frame = frame.withColumn(v, F.sort_array(ranked)).drop(s, runs)
    of_bin = lambda x: F.shiftright(x, 63 - BINS_BITS)
    before = F.concat(F.array_repeat(F.lit(None).cast("long"), TUPLE), F.slice(v, 1, F.greatest(F.size(v) - TUPLE, F.lit(0))))
    least = F.filter(F.zip_with(v, F.slice(before, 1, F.size(v)),
                                lambda x, b: F.when(b.isNull() | (of_bin(b) != of_bin(x)), x)), lambda x: x.isNotNull())
    frame = frame.withColumn(v, least)
    follow = F.zip_with(v, F.concat(F.slice(v, 2, F.size(v)), F.array(F.lit(None).cast("long"))),
                        lambda a, b: F.struct(a.alias("a"), F.when(of_bin(a) == of_bin(b), b).alias("b")))
    pairs = F.zip_with(follow, F.concat(F.array(F.lit(None).cast("long")), v), lambda p, before: F.when(
        p.isNotNull() & (before.isNull() | (of_bin(before) != of_bin(p["a"]))), p))
    pairs = F.filter(pairs, lambda p: p.isNotNull())

    def signature(p):
        at = lambda x: x.bitwiseAND(place.cast("long"))
        kmer = lambda x: F.shiftright(x, low)
        in_order = F.when(p["b"].isNull(), F.xxhash64(kmer(p["a"]))).when(
            at(p["a"]) < at(p["b"]), F.xxhash64(kmer(p["a"]), kmer(p["b"]))).otherwise(F.xxhash64(kmer(p["b"]), kmer(p["a"])))
        return F.shiftleft(in_order, BINS_BITS + 1).bitwiseOR(of_bin(p["a"])).bitwiseOR(F.lit(BINS if characters else 0).cast("long"))

    return frame.withColumn(name, F.transform(pairs, signature)).drop(v)


def fingerprint_string(signatures: str) -> Column:
    """The signatures in hex, by kind and bin; empty for a text without k-mers."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """From the share of the bins that either text uses in which both have the same tuple; 1 for two texts without k-mers.

    Compared by characters where both texts have k-mers of them, by words otherwise.

    All TUPLE k-mers of a tuple must agree, so the share's TUPLE-th root estimates that of one k-mer.
    """
    def of(c, characters):
        return F.filter(c, lambda x: (x.bitwiseAND(F.lit(BINS).cast("long")) != 0) == characters)

    def share(a, b):
        bins = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit(BINS - 1).cast("long")))
        used = F.size(F.array_union(bins(a), bins(b)))
        return F.when(used == 0, 1.0).otherwise(F.pow(F.size(F.array_intersect(a, b)) / used, F.lit(1.0 / TUPLE)))

    by_character = (F.size(of(a, True)) > 0) & (F.size(of(b, True)) > 0)
    return F.when(by_character, share(of(a, True), of(b, True))).otherwise(share(of(a, False), of(b, False)))


def with_next(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the document with the next larger id (after the last: the first).

    Ids are cut into RANGES ranges at approximate quantiles (their count does
    not depend on the data); rows travel once, and a row that begins a range
    travels a second time, to end the range before it.  Frame has doc_id and
    text; rows with one id are ordered by text, a null id comes last.
    """
    ids = frame.select("doc_id")
    cuts = ids.where("doc_id is not null").approxQuantile("doc_id", [k / RANGES for k in range(RANGES)], 1 / (4 * RANGES))

    def range_of(bounds: list[int]) -> Column:
        listed = F.array(*[F.lit(c).cast("long") for c in bounds])
        return F.greatest(F.size(F.filter(listed, lambda c: c <= F.col("doc_id"))) - 1, F.lit(0))

    # the smallest id of each range that has one (at most RANGES rows); -1: there are null ids
    named = range_of(sorted({int(c) for c in cuts})) if cuts else F.lit(0)
    found = ids.groupBy(F.when(F.col("doc_id").isNull(), -1).otherwise(named).alias("r")).agg(F.min("doc_id")).collect()
    bounds, has_null = sorted(x[1] for x in found if x[0] >= 0), any(x[0] < 0 for x in found)
    last = len(bounds)  # the range of null ids
    of_range = F.when(F.col("doc_id").isNull(), last).otherwise(range_of(bounds) if bounds else F.lit(0))
    copies = F.array_compact(F.array(
        F.struct(of_range.alias("range"), F.lit(0).alias("turn")),
        F.when(F.col("doc_id").isin(bounds[1:]), F.struct((of_range - 1).alias("range"), F.lit(1).alias("turn"))),
        F.when(F.col("doc_id").isin(bounds[:1]), F.struct(F.lit(last if has_null else last - 1).alias("range"), F.lit(2).alias("turn")))))
    dealt = frame.withColumn("_copy", F.explode(copies))
    if has_null and bounds:  # the first null follows the last id
        dealt = dealt.unionByName(frame.where("doc_id is null").orderBy("text").limit(1).withColumn(
            "_copy", F.struct(F.lit(last - 1).alias("range"), F.lit(1).alias("turn"))))
    order = Window.partitionBy("_copy.range").orderBy("_copy.turn", F.col("doc_id").asc_nulls_last(), "text")
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_copy.turn = 0").drop("_copy")
    if not bounds:  # only null ids: one range, whose last row is followed by its first
        whole = Window.orderBy("text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        dealt = dealt.withColumns({f"next_{c}": F.coalesce(f"next_{c}", F.first(c).over(whole)) for c in columns})
    return dealt


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and its fingerprint (array of signatures) of every document.

    A null text is empty; a text without units has an empty fingerprint.
    """
    prepare(docs.sparkSession)
    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return with_fingerprint(frame, "text", "signatures")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose last quarter the next document's start replaces.

    Rows may repeat; equal ids are ordered by text and a null id comes last.
    An empty table gives no rows; other columns are ignored.
    """
    frame = with_next(fingerprints(docs, id_col, text_col), ["text", "signatures"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - quarter), F.substring("next_text", 1, quarter))
    frame = with_fingerprint(frame.withColumn("edited", edited).drop("next_text"), "edited", "edited_signatures")
    return frame.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_string("signatures").alias("fingerprint"), fingerprint_string("edited_signatures").alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"))
