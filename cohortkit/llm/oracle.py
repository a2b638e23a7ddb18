"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import mixing, quality_rules

_SPACE = "'[ \\t-\\r]+'"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), {_SPACE}), lambda w: w <> '')"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _quality() -> str:
    classes = ", ".join(
        f"length(regexp_replace(t, '[^{chars}]+', '', 'g'))".replace("'\"()", "''\"()") for chars in quality_rules.CLASSES.values())
    listed = " ".join(f"WHEN '{lang}' THEN [{_quoted(words)}]" for lang, words in quality_rules.COMMON_WORDS.items())
    # the script of most characters: its count, padded, before its name, so that the largest text is the one
    scripts = ", ".join(f"lpad(CAST(length(regexp_replace(t, '[^\\p{{{s}}}]+', '', 'g')) AS VARCHAR), 12, '0') || '{s}'"
                        for s in quality_rules.SCRIPTS)
    distance = """
{name} AS (
  SELECT id, CASE WHEN min(ct) > 0 AND min(rt) > 0 THEN sqrt(greatest(sum(
           (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2
         ), 0)) ELSE 0 END AS distance
  FROM (SELECT id, ct, rt, c / nullif(ct, 0) AS p, coalesce(r, 0) / nullif(rt, 0) AS q
        FROM (SELECT x.id, x.i, CAST(x.c AS DOUBLE) AS c, CAST(y.c AS DOUBLE) AS r,
                     sum(x.c) OVER (PARTITION BY x.id) AS ct,
                     (SELECT sum(c) FROM {name}_pool z WHERE z.pool = x.pool) AS rt
              FROM {name}_bins x LEFT JOIN {name}_pool y ON y.pool = x.pool AND y.i = x.i))
  GROUP BY id)"""
    bins = """
{name}_bins AS (SELECT id, pool, language, n_words, unnest(range(1, len({col}) + 1)) AS i, unnest({col}) AS c,
                       list_sum({col}) AS whole FROM profile),
{name}_pool AS (
  SELECT pool, i, sum(CASE WHEN language = '{other}' THEN round(c * {share} / CAST(whole AS DOUBLE)) ELSE c END) AS c
  FROM {name}_bins WHERE n_words >= {least} GROUP BY pool, language, i
  HAVING language <> '{other}' OR (count(*) >= {documents} AND pool IS NOT NULL)),"""
    shape = {"least": quality_rules.MIN_WORDS, "other": quality_rules.OTHER, "share": quality_rules.SHARE,
             "documents": quality_rules.MIN_DOCUMENTS}
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, {_WORDS} AS words,
         CASE WHEN lang IN ({_quoted(quality_rules.COMMON_WORDS)}) THEN lang ELSE '{quality_rules.OTHER}' END AS language,
         coalesce(lang, '') AS given
  FROM documents),
scripted AS (
  SELECT *, CASE WHEN language = '{quality_rules.OTHER}' THEN list_max([{scripts}]) END AS script FROM docs),
counted AS (
  SELECT *, CASE WHEN language <> '{quality_rules.OTHER}' THEN language
                 WHEN substr(script, 1, 12) > '000000000000' THEN '{quality_rules.OTHER}:' || substr(script, 13) || ':' || given END AS pool,
         len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]+', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines,
         list_transform(list_filter(words, lambda w: list_contains([{_quoted(quality_rules._spellings())}], w)), lambda w: lower(w)) AS found,
         coalesce(CASE language {listed} END, []) AS listed, [{classes}] AS named
  FROM scripted),
profile AS (
  SELECT *, list_transform(listed, lambda k: len(list_filter(found, lambda w: w = k))) AS common,
         list_concat([length(t) - word_chars, n_symbols], named, [word_chars - n_symbols - list_sum(named)]) AS class_counts,
         list_concat(list_transform(listed, lambda k: len(list_filter(found, lambda w: w = k))), [CAST(n_words -
           coalesce(list_sum(list_transform(listed, lambda k: len(list_filter(found, lambda w: w = k)))), 0) AS BIGINT)]) AS word_counts
  FROM counted),
windows AS (SELECT id, words, unnest(range(1, n_words - 1)) AS i FROM counted WHERE n_words >= 3),
repeated AS (
  SELECT id, count(DISTINCT i + d) AS n FROM (
    SELECT id, i, count(*) OVER (PARTITION BY id, words[i], words[i + 1], words[i + 2]) AS n FROM windows) w,
    (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY id),
{bins.format(name="cls", col="class_counts", **shape).strip()}
{distance.format(name="cls").strip()},
{bins.format(name="wrd", col="word_counts", **shape).strip()}
{distance.format(name="wrd").strip()},
judged AS (
  SELECT p.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         c.distance AS class_distance, CASE WHEN language = '{quality_rules.OTHER}' THEN 0 ELSE w.distance END AS word_distance
  FROM profile p LEFT JOIN repeated r USING (id) LEFT JOIN cls c USING (id) LEFT JOIN wrd w USING (id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words < {quality_rules.MIN_WORDS} OR (
         class_distance <= {quality_rules.MAX_CLASS_DISTANCE} AND
         word_distance <= {quality_rules.MAX_WORD_DISTANCE} + {quality_rules.WORD_ALLOWANCE} / sqrt(greatest(n_words, 1)))) AS kept,
       round(class_distance, 4) AS class_distance, round(word_distance, 4) AS word_distance
FROM judged"""


def _mixing() -> str:
    weight = " ".join(f"WHEN {k} THEN {float(w)}" for k, w in enumerate(mixing.WEIGHTS))
    return f"""
WITH docs AS (
  SELECT doc_id, source, len({_WORDS}) AS size,
         CAST('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))),
                             1, {mixing.PLACE_BITS // 4}) AS BIGINT) AS place
  FROM documents),
sources AS (
  SELECT *, {mixing.MAX_EPOCHS} * source_size AS cap, {mixing.MAX_EPOCHS} * source_size / weight AS ratio FROM (
    SELECT source, source_size, number, CASE number % {len(mixing.WEIGHTS)} {weight} END AS weight FROM (
      SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
      FROM docs GROUP BY source))),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
chosen AS (SELECT arg_min(level, (ratio, number)) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT l.source, l.source_size, CAST(CASE WHEN c.level IS NULL THEN l.cap ELSE least(l.cap, c.level * l.weight) END AS DOUBLE) AS target
  FROM levels l LEFT JOIN chosen c ON true),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
ends AS (
  SELECT source, coalesce(max(place) FILTER (up_to <= rest), -1) AS last,
         min(rest) - coalesce(max(up_to) FILTER (up_to <= rest), 0) AS missing
  FROM placed WHERE rest > 0 GROUP BY source),
fillers AS (
  SELECT p.source, arg_min(p.place, (abs(p.size - e.missing), p.place)) AS filler
  FROM placed p JOIN ends e ON p.source IS NOT DISTINCT FROM e.source
  WHERE p.place > e.last AND abs(p.size - e.missing) < e.missing GROUP BY p.source),
taken AS (
  SELECT p.*, CAST(p.whole AS BIGINT) + CASE WHEN p.place <= coalesce(e.last, -1) OR p.place = coalesce(f.filler, -1) THEN 1 ELSE 0 END AS times
  FROM placed p LEFT JOIN ends e ON p.source IS NOT DISTINCT FROM e.source
  LEFT JOIN fillers f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 4) AS target,
       CAST(times * size AS BIGINT) AS taken, CAST(times AS BIGINT) AS times
FROM taken"""


_JACCARD = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[ \\t-\\r]+'), lambda w: w <> '') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT o.a, o.b FROM shared o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b
          WHERE 100 * o.n >= 75 * (x.n + y.n - o.n)),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, CAST(min(r.other) AS BIGINT) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reached r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


_AUDIT = """
WITH labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
counted AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words} AS words FROM documents),
cells AS (
  SELECT c.part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN c.doc_id > min(c.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM counted c LEFT JOIN labelled l ON l.doc_id = c.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE (v.b | w.b | x.b | y.b | z.b) = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM cells GROUP BY part, mask),
audited AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM audited""".format(words=_WORDS)


#: The checksum is worked out byte by byte; one recursion then reads a row of every conversation at a time and keeps
#: the cheapest edits to each state (0 nothing yet, 1 after s, 2 after u, 3 after a).
_REPAIR = """
WITH RECURSIVE bytes(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bytes WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS l FROM bytes WHERE k = 8),
named AS (
  SELECT DISTINCT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
harms AS (
  SELECT conv_id, turn, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                        lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM named, crc),
damaged AS (
  SELECT v.conv_id, v.turn, CASE WHEN harm = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM conversations v JOIN harms h ON h.conv_id IS NOT DISTINCT FROM v.conv_id AND h.turn IS NOT DISTINCT FROM v.turn),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faulty AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
         CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'blank'
              WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT c, f.* FROM faulty f JOIN convs v ON v.conv_id IS NOT DISTINCT FROM f.conv_id),
inserts AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 1, chr(10) || 'user:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, ''), (1, 2, 1, chr(10) || 'user:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, ''), (2, 3, 1, chr(10) || 'assistant:'), (3, 3, 0, ''), (3, 2, 1, chr(10) || 'user:')) AS t(q, q2, n, said)),
edits AS (SELECT * FROM (VALUES ('D', 0, 0, '', ''), ('D', 1, 1, '', ''), ('D', 2, 2, '', ''), ('D', 3, 3, '', ''),
  ('K', 0, 1, 's', ''), ('K', 0, 2, 'u', ''), ('K', 1, 2, 'u', ''), ('K', 2, 3, 'a', ''), ('K', 3, 2, 'u', ''),
  ('R', 0, 2, '', 'user'), ('R', 1, 2, '', 'user'), ('R', 2, 3, '', 'assistant'), ('R', 3, 2, '', 'user')) AS t(letter, q, q2, initial, role)),
fixed(c, i, q, cost, audit, said) AS (
  SELECT c, CAST(0 AS BIGINT), q2, 5 * n, repeat('I', n), said FROM convs, inserts WHERE q = 0
  UNION ALL
  SELECT c, i, q, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) AS rank FROM (
      SELECT f.c, r.i, x.q2 AS q,
             f.cost + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
               + CASE WHEN e.letter <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END + 5 * x.n AS cost,
             f.audit || e.letter || repeat('I', x.n) AS audit,
             f.said || CASE e.letter WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || e.role || ':' || r.text
                                     ELSE chr(10) || r.role || ':' || r.text END || x.said AS said
      FROM fixed f JOIN numbered r ON r.c = f.c AND r.i = f.i + 1
      JOIN edits e ON e.q = f.q AND (e.letter = 'D' OR r.fault IN ('', 'truncated') AND (e.letter = 'R' OR e.initial = r.initial))
      JOIN inserts x ON x.q = e.q2)) WHERE rank = 1),
lengths AS (
  SELECT v.c, v.conv_id, count(n.i) AS n, coalesce(max(n.turn) - min(n.turn) + 1 - count(DISTINCT n.turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM convs v LEFT JOIN numbered n ON n.c = v.c GROUP BY v.c, v.conv_id),
ranked AS (
  SELECT l.*, f.cost, f.audit, f.said, row_number() OVER (PARTITION BY l.c ORDER BY f.cost, f.audit) AS rank
  FROM lengths l JOIN fixed f ON f.c = l.c AND f.i = l.n AND f.q IN (0, 3))
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate,
       CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(substr(said, 2)) AS repaired_sha256
FROM ranked WHERE rank = 1"""


_WARC = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages),
digits AS (
  SELECT *, list_transform(string_split(h, ''), lambda x: instr('0123456789abcdef', x) - 1) AS d FROM hashed)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((16 * d[i * 5 // 4 + 1] + d[i * 5 // 4 + 2]) >> (3 - i * 5 % 4)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM digits"""

ORACLE = {
    "op6_quality_rules": _quality(),
    "op7_water_filling_mix": _mixing(),
    "op8_ngram_jaccard": _JACCARD,
    "op11_filter_audit": _AUDIT,
    "op12_conversation_repair": _REPAIR,
    "op13_warc": _WARC,
}
