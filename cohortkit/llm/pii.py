"""Personal data by bootstrapped contextual extraction, in DataFrame expressions.

Seeds are the valid matches of fixed patterns (email, ip, card, phone).  The
words beside their occurrences are lexical patterns, and so is a name that is
glued to them by a colon or an equals sign.  Patterns and candidates (tokens
with a digit or an at sign that no seed covers, with the groups of digits that
follow after one space) form a graph: a
pattern's confidence is the share of all occurrences of its word in the corpus
that stand beside an identifier of its kind, each counted by its own
confidence (1 for seeds), so that errors do not feed on themselves; a
candidate's is the noisy-or of
the confident patterns around any of its occurrences.  Candidates above the
limit become identifiers and induce patterns in the next round, until a round
finds nothing new.

Matches are cut out by splitting a text at them, so each match comes with the
length of the text since the one before, and places are running sums; texts
themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import prepare, staged, text_of

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Possessive repeats and the look-behinds only spare the regex engine vain attempts inside a
# run of characters whose first one has failed; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What can be an identifier: a token with a digit or an at sign, and further groups of two or more digits.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20\(?+[0-9]{2}[0-9().-]*+(?!\S))*+"
#: A name glued to what follows, and the mark of such a pattern.
GLUED, MARK = r"[\p{L}][\p{L}\p{N}_-]*+[:=]", "\x01"
#: Texts that can hold a match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]", "candidate": "[0-9@]"}
#: Characters on each side of a match in which its neighbouring word is sought.
CONTEXT = 64

#: A pattern needs so many distinct identifiers, and this confidence.
MIN_SUPPORT, MIN_CONFIDENCE = 3, 0.5
#: A candidate needs this confidence, and so many digits unless it holds an at sign.
MIN_SCORE, MIN_DIGITS = 0.5, 4


def _digits(c) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(d, i):
        d = d.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d < 5, 2 * d).otherwise(2 * d - 9))

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    small = F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True))


def _match_in(kind: str):
    """The i-th match of a kind as a struct, with the words beside it in the texts before and behind."""
    gaps = f"{kind}_gaps"

    def match(m, i):
        left, right = F.right(F.get(gaps, i), F.lit(CONTEXT)), F.left(F.get(gaps, i + 1), F.lit(CONTEXT))
        glued = F.regexp_extract(m if kind == "candidate" else left, f"^(?:{GLUED})" if kind == "candidate" else rf"(?<!\S)(?:{GLUED})$", 0)
        before = F.when(glued != "", F.concat(glued, F.lit(MARK))).otherwise(F.regexp_extract(left, r"(\S+)\s*$", 1))
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match"),
                        F.lower(before).alias("left"), F.lower(F.regexp_extract(right, r"^\s*(\S+)", 1)).alias("right"))

    return match


def _matches(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """One row a document: rid, row (the kept columns) and all matches with the text lengths between them."""
    frame = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), text_of(docs, text_col).alias("text"),
                        F.monotonically_increasing_id().alias("rid"))
    for kind, regex in {**PATTERNS, "candidate": CANDIDATE}.items():
        hinted = F.when(F.col("text").rlike(HINTS[kind]), F.col("text"))
        frame = frame.withColumns({f"{kind}_gaps": F.split(hinted, regex, -1),
                                   f"{kind}_found": F.regexp_extract_all(hinted, F.lit(regex), F.lit(0))})
        frame = frame.withColumn(kind, F.transform(f"{kind}_found", _match_in(kind))).drop(f"{kind}_found", f"{kind}_gaps")
    none = F.lit([]).cast("array<struct<kind:string,i:int,gap:int,match:string,left:string,right:string>>")
    return frame.select("rid", "row", F.concat(*[F.coalesce(F.col(k), none) for k in (*PATTERNS, "candidate")]).alias("matches"))


def _occurrences(matches: DataFrame) -> DataFrame:
    """(rid, kind, start, end, match, left, right) of valid base matches and of the candidates beside them."""
    rows = matches.where(F.size("matches") > 0).select("rid", F.explode("matches").alias("m")).select("rid", "m.*").repartition("rid")
    upto = Window.partitionBy("rid", "kind").orderBy("i")
    start = F.sum(F.col("gap") + F.length("match")).over(upto) - F.length("match")
    rows = rows.withColumn("start", start).where(_valid(F.col("kind"), F.col("match")))
    # a candidate's span is its token without the name glued to it and the punctuation around it
    around = rf"(?:{GLUED})?+[^\p{{L}}\p{{N}}+]*+"
    inner = F.regexp_replace("match", rf"^{around}|[^\p{{L}}\p{{N}}]++$", "")
    lead = F.length(F.regexp_extract("match", rf"^{around}", 0))
    is_base = F.col("kind") != "candidate"
    rows = rows.withColumns({"start": F.col("start") + F.when(is_base, 0).otherwise(lead),
                             "match": F.when(is_base, F.col("match")).otherwise(inner)})
    rows = rows.withColumn("end", F.col("start") + F.length("match"))
    order = Window.partitionBy("rid").orderBy("start", "end", "kind")
    base_end = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    possible = F.col("match").contains("@") | (F.length(_digits("match")) >= MIN_DIGITS)
    rows = rows.withColumn("free", free & possible).where(is_base | F.col("free"))
    return rows.select("rid", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                       "match", "left", "right")


def _word_totals(docs: DataFrame, text_col: str, contexts: DataFrame) -> DataFrame:
    """How often each context word occurs in all texts."""
    words = docs.select(F.explode(F.split(F.lower(text_of(docs, text_col)), r"[ \t-\r]+")).alias("word"))
    # a token that begins with a glued name is an occurrence of that name, too
    names = F.when(F.col("word").rlike("[:=]."), F.regexp_extract("word", f"^(?:{GLUED})(?=.)", 0))
    both = F.when(names != "", F.array(F.col("word"), F.concat(names, F.lit(MARK)))).otherwise(F.array("word"))
    words = words.select(F.explode(both).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("total")).join(contexts, "word", "left_semi")


def _bootstrap(docs: DataFrame, occurrences: DataFrame, text_col: str) -> DataFrame:
    """(value, kind) of the candidates that confident patterns discover."""
    value = F.lower("match")
    base = occurrences.where("kind <> 'candidate'").select("kind", value.alias("value"), "left", "right")
    candidate = occurrences.where("kind = 'candidate'").select(value.alias("value"), "left", "right")

    def sides(frame: DataFrame, *columns: str) -> DataFrame:
        side = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("word")),
                                 F.struct(F.lit("right").alias("side"), F.col("right").alias("word"))))
        return frame.select(*columns, side.alias("p")).select(*columns, "p.side", "p.word").where("word <> ''")

    near_base, near_candidate = sides(base, "kind", "value"), sides(candidate, "value")
    # words beside at least MIN_SUPPORT occurrences of either sort are the only ones that can become patterns
    beside = 2 * occurrences.count()  # rows of both sides at most
    contexts = (near_base.select("word").union(near_candidate.select("word")).groupBy("word").count()
                .where(F.col("count") >= MIN_SUPPORT).select("word"))
    totals = staged(_word_totals(docs, text_col, staged(contexts, "pii-contexts", beside)), "pii-totals")
    near_candidate = near_candidate.join(totals.select("word"), "word", "left_semi")
    near_candidate = staged(near_candidate.groupBy("value", "side", "word").agg(F.count("*").alias("n")), "pii-graph", beside)
    known = near_base.groupBy("kind", "value", "side", "word").agg(F.count("*").alias("n"))
    known = known.withColumn("score", F.lit(1.0))
    found = docs.sparkSession.createDataFrame([], "value string, kind string, score double")
    while True:  # every round but the last adds a value, and each value is added once
        labelled = known.unionByName(near_candidate.join(found, "value").select("kind", "value", "side", "word", "n", "score"))
        patterns = (labelled.groupBy("kind", "side", "word").agg(F.sum(F.col("n") * F.col("score")).alias("n"), F.count("*").alias("support"))
                    .where(F.col("support") >= MIN_SUPPORT).join(totals, "word")
                    .withColumn("confidence", F.col("n") / F.col("total")).where(F.col("confidence") >= MIN_CONFIDENCE))
        fits = F.when(F.col("kind") == "email", F.col("value").contains("@")).otherwise(~F.col("value").contains("@"))
        miss = F.product(1 - F.least("confidence", F.lit(0.99)))
        scored = (near_candidate.join(patterns.select("kind", "side", "word", "confidence"), ["side", "word"]).where(fits)
                  .groupBy("value", "kind").agg((1 - miss).alias("score")).where(F.col("score") >= MIN_SCORE))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("m")).select("value", "m.kind", "m.score")
        before = found
        found = staged(best.join(before.select("value"), "value", "left_anti").unionByName(before), "pii-found")
        if found.join(before.select("value"), "value", "left_anti").isEmpty():
            break
    return found.select("value", "kind")


def pii_spans(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns ``row`` (a struct of the kept columns, all by default) and
    ``spans``: an array of (kind, start, end, base, match, behind) sorted by
    start, in code points with an exclusive end; base tells seeds from
    discoveries, behind is the largest end of the spans before.  A text without
    personal data, or null, has an empty array.  Repeated rows have equal
    spans; columns of ``docs`` never clash, as they stay inside ``row``.
    """
    prepare(docs.sparkSession)
    matches = staged(_matches(docs, docs.columns if keep is None else keep, text_col), "pii-matches")
    occurrences = staged(_occurrences(matches.select("rid", "matches")), "pii-occurrences")
    found = _bootstrap(docs, occurrences, text_col)
    base = occurrences.where("kind <> 'candidate'").withColumn("base", F.lit(True))
    more = occurrences.where("kind = 'candidate'").drop("kind").join(found, F.lower("match") == F.col("value"))
    spans = base.unionByName(more.drop("value").withColumn("base", F.lit(False))).repartition("rid")
    order = Window.partitionBy("rid").orderBy("start", "end", "kind")
    behind = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("behind", F.coalesce(behind, F.lit(0)))
    spans = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "base", "match", "behind"))).alias("spans"))
    none = F.lit([]).cast("array<struct<start:bigint,end:bigint,kind:string,base:boolean,match:string,behind:bigint>>")
    return matches.select("rid", "row").join(spans, "rid", "left").select("row", F.coalesce("spans", none).alias("spans"))


def span_digest(spans, base_only: bool) -> Column:
    """kind:start:end of the spans, by kind as listed in KINDS and then start, comma-joined."""
    def of(kind: str) -> Column:
        wanted = F.filter(spans, lambda s: (s["kind"] == kind) & (s["base"] if base_only else F.lit(True)))
        return F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(of, KINDS)), ",")


def redacted(text: Column, spans) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    def piece(s):
        kept = F.when(s["start"] > s["behind"], F.substr(text, s["behind"].cast("int") + 1, (s["start"] - s["behind"]).cast("int"))).otherwise("")
        return F.concat(kept, F.when(s["start"] >= s["behind"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))

    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)).cast("int")
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(text, end + 1, F.length(text))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced; all columns and null texts stay."""
    spans = pii_spans(docs, text_col=text_col)
    text = F.col("row").getField(text_col).cast("string")
    return spans.select(*[
        redacted(text, F.col("spans")).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
