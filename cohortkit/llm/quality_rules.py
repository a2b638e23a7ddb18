"""Quality rules: length and repetition guards, then distribution divergence.

A document's character classes and common words are counted into two
histograms and compared with its language's reference by Jensen-Shannon
distance (base 2, 0 to 1).  The references are the pooled histograms of all
documents of the language that are long enough, so they follow the corpus; an
unlisted or missing language is pooled by itself and the text's main script,
each document with equal weight.  Everything is DataFrame expressions: the
texts are read once for the histograms, which are written; references and
verdicts come from the written histograms, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import prepare, staged, text_of

# The commonest function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "für", "auf", "nicht", "ein", "im", "des"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "as", "with", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"],
}
#: Mark of the languages without a list of common words (compared by character classes only).
OTHER = "other"
#: Scripts told apart within an unlisted language; a text of none of them gets no verdict.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Armenian", "Georgian", "Devanagari", "Bengali", "Gurmukhi", "Gujarati",
           "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Khmer", "Ethiopic",
           "Mongolian", "Hangul", "Hiragana", "Katakana", "Han")
#: Fewer long documents than this are no reference for an unlisted language.
MIN_DOCUMENTS = 20
#: Each document's weight in an unlisted language's reference (whole numbers, so that sums are exact).
SHARE = 1_000_000
#: More references than this are not broadcast.
BROADCAST_ROWS = 4096
#: Character classes besides white space, symbols and the rest (mostly small letters).
CLASSES = {"upper": "A-Z", "digit": "0-9", "punctuation": ".,;:!?'\"()\\-", "beyond_ascii": "\\x{80}-\\x{10FFFF}"}
SPACE = " \\t-\\r"
SYMBOLS = "#*$%&|<>"

#: Fewer words than this say too little about a distribution: no verdict from it.
MIN_WORDS = 100
#: Largest Jensen-Shannon distances that are kept.  A short text's word histogram strays by chance,
#: so its limit has an allowance that shrinks with the root of the number of words.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORD_ALLOWANCE = 0.30, 0.15, 1.2


def _repeat_words(frame: DataFrame) -> DataFrame:
    """Words that lie in a 3-word window found twice or more; frame has words and n_words."""
    window = F.when(F.col("n_words") >= 3, F.transform(
        F.slice("words", 1, F.greatest(F.col("n_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    frame = frame.withColumn("windows", window)
    # the same windows by value and place, only where some occur again
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    frame = frame.withColumn("by_value", F.when(again, F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.filter(
        F.zip_with("by_value", F.slice("by_value", 2, F.size("by_value")),
                   lambda a, b: F.struct((a["h"] == b["h"]).alias("same"), a["i"].alias("x"), b["i"].alias("y"))),
        lambda t: t["same"])
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(twins, lambda t: F.array(t["x"], t["y"])))))
    frame = frame.withColumn("places", places)
    reach = F.zip_with("places", F.slice("places", 2, F.size("places")),
                       lambda p, q: F.coalesce(F.least(q - p, F.lit(3)), F.lit(3)))
    covered = F.aggregate(reach, F.lit(0), lambda s, x: s + x)
    return (frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .drop("windows", "by_value", "places"))


def _script(text: str) -> Column:
    """The script of most of the text's characters; null when it has none of SCRIPTS."""
    scripts = F.array(*map(F.lit, SCRIPTS))
    most = F.array_max(F.transform(scripts, lambda s: F.struct(
        F.length(F.regexp_replace(text, F.concat(F.lit("\\P{Is"), s, F.lit("}+")), F.lit(""))).alias("n"), s.alias("s"))))
    return F.when(most["n"] > 0, most["s"])


def _profile(docs: DataFrame, keep: list[str], text_col: str, lang_col: str | None) -> DataFrame:
    """The base counts and the two histograms of each document, beside its kept columns as ``row``."""
    language = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    frame = docs.select(F.struct(*[docs[c] for c in keep]).alias("row") if keep else F.lit(None).alias("row"),
                        text_of(docs, text_col).alias("text"),
                        F.when(language.isin(*COMMON_WORDS), language).otherwise(F.lit(OTHER)).alias("language"),
                        F.coalesce(language, F.lit("")).alias("given"))
    frame = frame.withColumn("pool", F.when(F.col("language") == OTHER, F.concat_ws(":", F.lit(OTHER), _script("text"), "given"))
                             .otherwise(F.col("language"))).drop("given")
    frame = frame.withColumn("words", F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""))
    frame = frame.withColumns({
        "n_words": F.size("words").cast("int"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long"),
        "found": F.transform(F.filter("words", lambda w: w.isin(*_spellings())), lambda w: F.lower(w)),
        **{name: F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long") for name, chars in CLASSES.items()},
    })
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    frame = frame.withColumn("lines", lines)
    frame = frame.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    frame = _repeat_words(frame).drop("lines")
    listed = F.create_map(*[x for lang, words in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))])
    listed = F.coalesce(F.try_element_at(listed, F.col("language")), F.array().cast("array<string>"))
    frame = frame.withColumn("common", F.transform(listed, lambda k: F.size(
        F.filter("found", lambda w: w == k)).cast("long"))).withColumn("n_found", F.size("found"))
    known = F.col("word_chars") - F.col("n_symbols") - sum(F.col(c) for c in CLASSES)
    classes = [F.length("text") - F.col("word_chars"), F.col("n_symbols"), *map(F.col, CLASSES), known]
    return frame.withColumns({
        "class_counts": F.array(*[c.cast("long") for c in classes]),
        "word_counts": F.array_append("common", F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)),
    }).drop("text", "words", "found", "n_found", "common", *CLASSES)


def _spellings() -> list[str]:
    words = {w for words in COMMON_WORDS.values() for w in words}
    return sorted(words | {w.capitalize() for w in words} | {w.upper() for w in words})


def references(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Pooled histograms by ``pool``: one row per listed language, and per unlisted language and script of MIN_DOCUMENTS or more.

    Listed languages are summed by characters and words, others by the shares of each document.
    """
    return _pooled(_profile(docs, [], text_col, lang_col))


def _pooled(profile: DataFrame) -> DataFrame:
    profile = profile.where(F.col("n_words") >= MIN_WORDS)
    total = F.aggregate("class_counts", F.lit(0).cast("long"), lambda s, x: s + x)
    shares = F.transform("class_counts", lambda x: F.round(x * SHARE / total).cast("long"))
    profile = profile.withColumn("class_counts", F.when(F.col("language") == OTHER, shares).otherwise(F.col("class_counts")))

    def pooled(column: str, n: int) -> Column:
        return F.array(*[F.sum(F.coalesce(F.get(column, F.lit(i)), F.lit(0))) for i in range(n)])

    n_classes, n_common = len(CLASSES) + 3, max(map(len, COMMON_WORDS.values())) + 1
    pools = profile.groupBy("language", "pool").agg(pooled("class_counts", n_classes).alias("class_reference"),
                                                    pooled("word_counts", n_common).alias("word_reference"),
                                                    F.count("*").alias("n_documents"))
    named = F.col("pool").rlike(f"^{OTHER}:({'|'.join(SCRIPTS)}):")
    return pools.where((F.col("language") != OTHER) | (named & (F.col("n_documents") >= MIN_DOCUMENTS))).drop("language", "n_documents")


def jensen_shannon(counts: str, reference: str) -> Column:
    """Distance of two histograms of counts, 0 when either is empty; a shorter one ends in zeros."""
    def total(column):
        return F.aggregate(column, F.lit(0).cast("double"), lambda s, x: s + x)

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(x, y):
        p, q = F.coalesce(x, F.lit(0)) / total(counts), F.coalesce(y, F.lit(0)) / total(reference)
        return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

    divergence = total(F.zip_with(counts, reference, term))
    return F.when((total(counts) > 0) & (total(reference) > 0),
                  F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text",
                  lang_col: str | None = "lang") -> DataFrame:
    """Judge every document; returns ``row`` (a struct of the kept columns, all by default), counts and ``kept``.

    base_failed: fewer than 50 words, or more than half of the words in
    repeated 3-word windows.  kept: not base_failed and, with MIN_WORDS words
    or more, both Jensen-Shannon distances within their limits.  A null text
    has no words and fails; a null or unlisted language is compared by
    character classes only, with the documents of the same language value and
    main script; one with fewer than MIN_DOCUMENTS long documents, like a
    listed one with none, has no reference and a distance of 0.  Repeated rows are judged
    alike; columns of ``docs`` never clash, as they stay inside ``row``.
    """
    prepare(docs.sparkSession)
    profile = staged(_profile(docs, docs.columns if keep is None else keep, text_col, lang_col), "quality-profiles")
    # a row for each pool; a column of thousands of language values is left to Spark's choice of join
    known = staged(_pooled(profile), "quality-references")
    judged = profile.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "pool", "left")
    judged = judged.withColumns({
        "class_distance": F.coalesce(jensen_shannon("class_counts", "class_reference"), F.lit(0.0)),
        "word_distance": F.when(F.col("language") == OTHER, F.lit(0.0)).otherwise(
            F.coalesce(jensen_shannon("word_counts", "word_reference"), F.lit(0.0))),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })
    word_limit = MAX_WORD_DISTANCE + WORD_ALLOWANCE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    near = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("word_distance") <= word_limit)
    return judged.select("row", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "class_distance", "word_distance",
                         (~F.col("base_failed") & ((F.col("n_words") < MIN_WORDS) | near)).alias("kept"))
