"""Quality rules, personal data, fingerprints and licenses against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from cohortkit.llm import license_rules, order_minhash, pii, quality_rules

SPACE = r"[\x20\x09-\x0D]"


def words_of(text):
    return [w for w in re.split(SPACE + "+", text or "") if w]


def base_quality(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if count[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


@pytest.mark.parametrize("table", ["docs", "odd_docs"])
def test_quality_base(table, request):
    frame = request.getfixturevalue(table)
    rows = quality_rules.quality_rules(frame).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                     "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert tuple(r)[1:7] == base_quality(r["text"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_columns_and_empty_table(odd_docs, no_docs):
    assert quality_rules.quality_rules(odd_docs).select("row.*").columns == odd_docs.columns
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_jensen_shannon(spark):
    a, b = [3, 0, 5, 2], [1, 4, 0]
    frame = spark.createDataFrame([(a, b), (a, a), ([], b), ([0, 0], b)], "x array<long>, y array<long>")
    got = [r[0] for r in frame.select(quality_rules.jensen_shannon("x", "y")).collect()]

    def distance(x, y):
        n = max(len(x), len(y))
        p, q = ([v / sum(z) for v in z] + [0] * (n - len(z)) for z in (x, y))
        part = lambda u, m: u * math.log2(u / m) if u else 0
        return math.sqrt(max(0, sum(part(u, (u + v) / 2) + part(v, (u + v) / 2) for u, v in zip(p, q)) / 2))

    assert got == pytest.approx([distance(a, b), 0, 0, 0], abs=1e-7)


def test_quality_rejects_foreign_distribution(spark, docs):
    prose = [r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    rows = [(k, t, "en") for k, t in enumerate(prose)]
    rows.append((99, " ".join(f"{w}***" for t in prose for w in t.split()[:40]), "en"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame).select("row.doc_id", "kept").collect()}
    assert not kept[99]
    assert all(kept[k] for k, t in enumerate(prose) if not base_quality(t)[5] and "|" not in t and "**" not in t)


def test_quality_keeps_clean_texts_of_unlisted_languages(spark):
    """Clean Russian and Portuguese, tagged, untagged and under one shared tag, beside a language of few documents."""
    russian = "Сегодня утром мы вышли из дома и долго шли вдоль реки пока не увидели старый мост за которым начинался лес"
    portuguese = "Hoje de manhã saímos de casa e andámos muito tempo junto ao rio até vermos a ponte velha atrás da floresta"

    def text(prose, k):
        return " ".join(w + "," * (j % 9 == 0) for j, w in enumerate(random.Random(k).choices(prose.split(), k=150)))

    rows = [(text(p, k), lang) for n, lang_of in ((30, lambda own: own), (30, lambda own: None), (30, lambda own: "und"))
            for p, own in ((russian, "ru"), (portuguese, "pt")) for lang in [lang_of(own)] for k in range(n)]
    rows += [(text(russian, k), "bg") for k in range(2)] + [(" ".join(f"{k}***&&&{j}" for j in range(150)), "bg") for k in range(2)]
    rows += [(" ".join(f"7***&&&{j}мы" for j in range(150)), "ru")]
    frame = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame).select("row.doc_id", "kept", "base_failed", "class_distance").collect()}
    assert len(got) == len(rows) and not any(r["base_failed"] for r in got.values())
    assert all(got[k]["kept"] for k in range(len(rows) - 1))
    assert not got[len(rows) - 1]["kept"]


def test_quality_reference_weighs_documents_alike(spark):
    """A few very long documents of an unlisted language don't set its reference."""
    rows = [(k, " ".join(f"palavra{'abcdefghijk'[(j * k) % 11]}{'qrstuvwxyz'[j % 10]}{j}" for j in range(120)).replace("0", "o"), "pt") for k in range(30)]
    rows += [(100, " ".join(f"Ж{j}ЖЩЦХ" for j in range(60_000)), "pt")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame).select("row.doc_id", "kept").collect()}
    assert all(got[k] for k in range(30))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    ds = [int(c) for c in reversed(digits)]
    return (sum(ds[::2]) + sum(sum(divmod(2 * d, 10)) for d in ds[1::2])) % 10 == 0


def base_spans(text):
    out = []
    for kind, regex in PII.items():
        for m in re.finditer(regex, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


HARD = ["a@b.c%x@d.e", "a@b.com.x@y.org 1.2.3.4.5.6.7.8 1.2.3 300.1.1.1 001.2.3.4", "", None, "+1 2 3", "+12345678 9",
        "é\U0001d11e x@y.zz +1 (705) 555-5569, 4111 1111 1111 1111-5 4111-1111-1111-1111", "....@-.-", "x@y z@w.q",
        "1.2.3.4@a.b", "tel 4111111111111111.2.3.4", "a@b@c.d@e.f", "9" * 3000, "a" * 3000 + "@", "1." * 3000]


def test_pii_base_spans(spark, texts):
    rows = list(texts.items()) + [(10_000 + k, t) for k, t in enumerate(HARD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
           for r in pii.pii_spans(frame).select("row.doc_id", "spans").collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert sorted(got[doc_id]) == sorted(base_spans(text))


def test_pii_discovers_in_context(spark):
    rows = [(k, f"hello there acctphone +1 (70{k}) 555-016{k} and more words") for k in range(9)]
    rows += [(20 + k, f"some other acctphone 555-01{k}9 is unseen, and number 12345{k} is not") for k in range(3)]
    found = pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    more = {r["doc_id"]: [s["match"] for s in r["spans"] if not s["base"]] for r in found.select("row.doc_id", "spans").collect()}
    assert {k: v for k, v in more.items() if v} == {20 + k: [f"555-01{k}9"] for k in range(3)}


def test_pii_discovers_groups_of_digits_and_glued_names(spark):
    rows = [(k, f"hello there acctphone +1 (70{k}) 555-016{k} and more words") for k in range(9)]
    rows += [(10 + k, f"see tel:+49 30 12345{k}67 or write") for k in range(6)]
    rows += [(20, "other acctphone (705) 555-0169 is new"), (21, "an acctphone 0301 234567 too"), (22, "short tel:555-01999, again"),
             (23, "none here 0301 234568 nor time:555-01998"), (24, "acctphone one 12 34")]
    found = pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    more = {r["doc_id"]: [s["match"] for s in r["spans"] if not s["base"]] for r in found.select("row.doc_id", "spans").collect()}
    assert {k: v for k, v in more.items() if v} == {20: ["705) 555-0169"], 21: ["0301 234567"], 22: ["555-01999"]}


def test_pii_bootstraps_until_nothing_is_new(spark):
    """Each label stands beside numbers that only the label before it gives away, five rounds deep."""
    known, rows = [f"+1 (705) 555-01{k}{k}" for k in range(5)], []
    for level, label in enumerate(("desk", "home", "shop", "work", "yard")):
        fresh = [f"{level + 2}{k}4-81{level}{k}" for k in range(5)]
        rows += [f"{n} {label}" for n in known] * 10 + [f"{n} {label}" for n in fresh]
        known = fresh
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = [len(r["spans"]) for r in pii.pii_spans(frame).collect()]
    assert spans == [1] * len(rows)


def test_pii_redaction(odd_docs, no_docs, spark):
    clean = pii.redact(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_id[9].startswith("mail [EMAIL] now \U0001d11eé ") and by_id[1] in (None, "") and by_id[6] == "one"
    assert pii.redact(no_docs).count() == 0
    both = pii.redact(spark.createDataFrame([(1, "x 1.2.3.4@a.bc y")], "doc_id long, text string")).first()
    assert both["text"] in ("x [IP] y", "x [EMAIL] y")


def test_fingerprints(spark, texts):
    rows = list(texts.items()) + [(10_001, None), (10_002, "abc"), (10_003, "abc"), (10_007, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in order_minhash.edited_fingerprints(frame).collect()}
    ordered = [(k, t or "") for k, t in sorted(rows)]
    by_text = {}
    for (k, text), (_, behind) in zip(ordered, ordered[1:] + ordered[:1]):
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + behind[:quarter]
        assert got[k]["n_chars"] == len(text)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(got[k]["fingerprint"])
        by_text.setdefault(edited, set()).add(got[k]["edited_fingerprint"])
        if edited == text:
            assert got[k]["near_edited"] == 1
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.45
    assert sorted(r["near_next"] for r in long)[len(long) // 2] < 0.1


def test_fingerprint_follows_order(spark):
    words = [f"w{k}" for k in range(400)]
    moved = words[200:] + words[:200]
    shuffled = [w for k in range(0, 400, 2) for w in (words[(k * 7) % 400], words[(k * 7 + 1) % 400])]
    frame = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(moved)), (2, " ".join(shuffled))], "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in order_minhash.edited_fingerprints(frame).collect()}
    assert 0.5 < near[0] < 1 and near[2] < near[0]


@pytest.mark.parametrize("text", [
    " ".join(f"w{k}" for k in range(200))[:order_minhash.CHARACTER_TEXT],  # at the limit of the second kind of unit
    "".join(chr(0x4E00 + k * k * 37 % 5000) for k in range(900)),  # no spaces
    "data " + hashlib.sha512(b"x").hexdigest() * 2 + hashlib.sha512(b"y").hexdigest() * 3])
def test_fingerprint_of_near_copies(spark, text):
    """A copy with one character more is near, an unrelated text of the sort is not."""
    other = "".join(chr(ord(c) ^ 3) if k % 2 else c for k, c in enumerate(text[::-1]))
    copies = [text, text + "z", text[:100] + "q" + text[100:]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*copies, other])], "doc_id long, text string")
    got = {r["doc_id"]: r["signatures"] for r in order_minhash.fingerprints(frame).collect()}
    rows = spark.createDataFrame([(got[0], got[k]) for k in (1, 2, 3)], "a array<long>, b array<long>")
    one_more, inserted, unrelated = (r[0] for r in rows.select(order_minhash.likeness("a", "b")).collect())
    assert one_more > 0.9 and inserted > 0.8 and unrelated < 0.3


def test_fingerprint_odd_rows(odd_docs, no_docs, spark):
    assert order_minhash.edited_fingerprints(odd_docs).count() == odd_docs.count()
    assert order_minhash.edited_fingerprints(no_docs).count() == 0
    only_null = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id long, text string")
    assert order_minhash.edited_fingerprints(only_null).count() == 2
    one = order_minhash.edited_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_license_base(spark, texts):
    rows = list(texts.items()) + [(10_000, None), (10_001, "MIT License, MIT LICENSE; cc-by cc byé GNU general-public license")]
    got = {r["doc_id"]: r for r in license_rules.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places, labels = [], set()
        for phrase, label in license_rules.BASE_PHRASES.items():
            seek = phrase.split(" ")
            here = [i for i in range(len(words)) if words[i:i + len(seek)] == seek]
            places += here
            labels |= {label} if here else set()
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules(spark, odd_docs, no_docs):
    assert len(license_rules.rules()) > 300
    cases = {"Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "SPDX-License-Identifier: BSD-3-Clause": "bsd",
             "GNU Lesser General Public License v2.1": "lgpl", "submitted by the bsdish author": "",
             "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit"}
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_rules.license_scan(frame).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert license_rules.license_scan(odd_docs).count() == odd_docs.count()
    assert license_rules.license_scan(no_docs).count() == 0


def samples(parsed):
    """Texts that a parsed regex matches: every alternative, and every optional part with and without."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(x if str(o) == "LITERAL" else x[0]) for o, x in arg]
        elif name == "BRANCH":
            more = [t for branch in arg[1] for t in samples(branch)]
        elif name == "SUBPATTERN":
            more = samples(arg[3])
        elif name == "MAX_REPEAT":
            more = ([""] if arg[0] == 0 else []) + samples(arg[2])
        else:
            assert name == "ASSERT_NOT", name
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_license_keywords_lose_no_match():
    from re import _parser

    for label, name, keywords in license_rules.FAMILIES:
        for text in samples(_parser.parse(name)):
            assert any(k in text for k in keywords), (label, text)
    for label, _, pattern, keywords in license_rules.CLAUSES:
        for text in samples(_parser.parse(pattern)):
            assert any(k in text for k in keywords), (label, text)


def test_license_spelled_out_creative_commons(spark):
    cases = {f"Licensed under Creative Commons {c.upper()} 4.0": c for c in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")}
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in license_rules.license_scan(frame).collect():
        assert f"cc-{list(cases.values())[r['doc_id']]}" in r["labels"].split(",") and r["score"] > 0.9
