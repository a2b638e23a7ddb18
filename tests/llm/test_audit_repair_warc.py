"""Filter audit, conversation repair and WARC archives against brute force."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import conversation_repair as cr
from cohortkit.llm import filter_audit as fa
from cohortkit.llm import queries, warc

SPACE = " \t\n\v\f\r"


# --- filter audit ---

def failures(rows):
    """rows: (doc_id, text, source) -> set of failed filters for each row."""
    found = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, _ in rows):
            bad.add("E")
        found.append(bad)
    return found


def audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = failures(rows)
    result = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        steps, shapley = {}, Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                gone = [m for m in left if c in m[1]]
                redundant = sum(c in f for _, f in mine) - len(gone)
                left = [m for m in left if c not in m[1]]
                shapley[c] += len(gone)
                steps["".join(order), k + 1] = (
                    c, len(left), len(gone), redundant, sum(f == {c} for _, f in mine),
                    sum(i is not None and i in good for i, _ in gone), sum(i is not None and i in toxic for i, _ in gone))
        for key, (c, *counts) in steps.items():
            result[(part, *key)] = (*counts, shapley[c])
    return result


def spark_audit(spark, rows, labels, extra=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("x").alias(c) for c in extra])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in fa.filter_audit(docs, known).collect()}


def test_filter_audit(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.limit(120).collect()]
    rows += [(5000 + i, t, s) for i, (t, s) in enumerate([(None, None), ("", "new"), (" \n", None), ("one TWO # three", "new"),
                                                          (" a b a b a b\t", "new"), ("w " * 300, ""), (rows[3][1], "new")])]
    rows += [(None, "w " * 300, "new"), (None, None, "new"), rows[0], rows[0], (0, "é" * 10 + "A", None)]
    labels = [(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows[:80])] + [(rows[0][0], 1, 1), (None, 1, 1), (5003, None, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    assert spark_audit(spark, rows, labels, ("mask", "part", "good", "digest")) == audit(rows, labels)


def test_filter_audit_long_text_and_empty_table(spark, no_docs, odd_docs):
    rows = [(1, " ".join(f"w{i}" for i in range(150_000)), "a"), (2, "x " * 200_000, "a")]
    assert spark_audit(spark, rows, [(1, 1, 0)]) == audit(rows, [(1, 1, 0)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(no_docs, empty).count() == 0
    assert fa.filter_audit(odd_docs, empty).count() == 600 * odd_docs.select(F.coalesce("source", F.lit(""))).distinct().count()


def test_gray_walk_equals_sums():
    import numpy as np

    cells = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    states = fa.gray_walk(cells)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


# --- conversation repair ---

def damaged(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: damaged rows (turn, role, text) in order}."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return {c: sorted(k, key=lambda r: (r[0] is not None, r[0] or 0)) for c, k in found.items()}


def faults(rows):
    met, found = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        found.append("blank" if not bare else "duplicate" if (role, text) in met else "truncated" if bare[-1] not in ".!?" else "")
        met.add((role, text))
    return found


def all_repairs(rows, most):
    """Every edit sequence of cost up to ``most`` whose result is legal: (cost, audit, messages)."""
    marks = faults(rows)

    def go(i, cost, letters, messages):
        if cost > most:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join((r[:1] or "-") for r, _ in messages)):
                yield cost, letters, messages
        else:
            _, role, text = rows[i]
            yield from go(i + 1, cost + 2, letters + "D", messages)
            if marks[i] not in ("blank", "duplicate"):
                extra = 5 if marks[i] == "truncated" else 0
                yield from go(i + 1, cost + extra, letters + "K", [*messages, (role, text)])
                for new in ("user", "assistant"):
                    yield from go(i + 1, cost + 1 + extra, letters + "R", [*messages, (new, text)])
        if sum(1 for x in letters if x == "I") < 3:
            for new in ("user", "assistant"):
                yield from go(i, cost + 5, letters + "I", [*messages, (new, "")])
    return go(0, 0, "", [])


def enumerated(rows):
    """The report's cost, audit and text from the enumeration of all repairs that cost no more than deleting all."""
    return min((c, a, m) for c, a, m in all_repairs(rows, 2 * len(rows)))


def by_prefix(rows):
    """The same for longer conversations: the lightest repair of every prefix to every state, as plain tuples."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def filled(states):
        for _ in range(3):
            for state, (cost, letters, messages) in list(states.items()):
                for x in "ua":
                    if (state, x) in follow:
                        new = (cost + 5, letters + "I", [*messages, (names[x], "")])
                        at = follow[state, x]
                        if at not in states or new[:2] < states[at][:2]:
                            states[at] = new
        return states

    states = filled({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        fresh = {}
        for state, (cost, letters, messages) in states.items():
            options = [(state, cost + 2, "D", [])]
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if (state, role[:1]) in follow:
                    options.append((follow[state, role[:1]], cost + extra, "K", [(role, text)]))
                options += [(follow[state, x], cost + 1 + extra, "R", [(names[x], text)]) for x in "ua" if (state, x) in follow]
            for at, c, letter, more in options:
                new = (c, letters + letter, messages + more)
                if at not in fresh or new[:2] < fresh[at][:2]:
                    fresh[at] = new
        states = filled(fresh)
    return min(states[s] for s in ("", "a") if s in states)


def expected_report(rows, solve):
    marks, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    cost, letters, messages = solve(rows)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
    return (gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha)


def reports(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    got = cr.repair_reports(cr.damage(frame)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r.conv_id: tuple(r[n] for n in names) for r in got}
    assert len(found) == len(got)
    return found


def some_rows(rng, conv, n, turns=None):
    return [(conv, i if turns is None else rng.choice(turns), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
             rng.choice(["Yes.", "no", " ", None, "Go on! ", f"text {i}.", f"text {i}"])) for i in range(n)]


def test_repairs_are_cheapest(spark):
    rng = random.Random(3)
    rows = [r for c in range(150) for r in some_rows(rng, c, rng.randrange(1, 6))]
    want = {c: expected_report(k, enumerated) for c, k in damaged(rows).items()}
    assert want == {c: expected_report(k, by_prefix) for c, k in damaged(rows).items()}
    assert reports(spark, rows) == want


@pytest.mark.parametrize("block_rows", [1, 7, 256])
def test_long_conversations_in_blocks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(cr, "SHORT_ROWS", 3 * block_rows)
    rng = random.Random(block_rows)
    rows = [r for c in (1, 2, None, 9) for r in some_rows(rng, c, 90 if block_rows < 256 else 1200)]
    rows += [r for c in range(20, 30) for r in some_rows(rng, c, 12)]
    assert reports(spark, rows) == {c: expected_report(k, by_prefix) for c, k in damaged(rows).items()}


def test_repair_odd_rows(spark, conversations_of_data):
    rows = [(1, None, None, None), (1, None, None, None), (2, 5, "user", "x" * 300_000 + "."), (2, 5, "user", "x" * 300_000 + "."),
            (None, None, "user", "Hi."), (None, 3, "assistant", "Ho."), (3, 0, "", "."), (4, -2, "user", "é?"), (4, 2, "assistant", "\v")]
    assert reports(spark, rows) == {c: expected_report(k, by_prefix) for c, k in damaged(rows).items()}
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert reports(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert reports(spark, []) == {}
    assert reports(spark, conversations_of_data) == {c: expected_report(k, by_prefix) for c, k in damaged(conversations_of_data).items()}


@pytest.fixture(scope="module")
def conversations_of_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    return [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]


def test_messages_come_with_the_reports(spark):
    rows = some_rows(random.Random(5), 1, 40) + some_rows(random.Random(6), 2, 6)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repair = cr.repair_structure(cr.damage(frame))
    found = {r.conv_id: [tuple(m) for m in r.messages] for r in repair.whole.collect()}
    for r in repair.blocks.orderBy("conv_id", "block").collect():
        found.setdefault(r.conv_id, []).extend(tuple(m) for m in r.messages)
    assert found == {c: by_prefix(k)[2] for c, k in damaged(rows).items()}


# --- WARC ---

def expected_pages(rows, least=0):
    found = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if same and len(data) >= least else None
        revisit = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        found[page, len(data), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    return found


def read_back(spark, rows, monkeypatch, tmp_path, **options):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit("x").alias("payload"))
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    given = warc.round_trip
    monkeypatch.setattr(warc, "round_trip", lambda pages: given(pages, **options))
    got = queries.QUERIES["op13_warc"](spark, str(tmp_path)).collect()
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)


PAGES = ([(i, f"https://x.org/{i}", f"<p>{i % 7} é</p>" * (i % 11)) for i in range(60)]
         + [(100, None, None), (101, "a\r\nWARC-Type: x%", ""), (None, "n", "same"), (None, None, "only here"), (None, None, "only here"),
            (7, "u", "same"), (3, "u", "same"), (3, "u", "same"), (102, "big", "\U0001d11e<b>" * 300_000)])


@pytest.mark.parametrize("least", [0, 20])
def test_warc_round_trip(spark, monkeypatch, tmp_path, least):
    assert read_back(spark, PAGES, monkeypatch, tmp_path, min_revisit_bytes=least) == expected_pages(PAGES, least)


def test_warc_empty_table(spark, monkeypatch, tmp_path):
    assert read_back(spark, [], monkeypatch, tmp_path) == Counter()


def test_warc_files_are_plain_gzip(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    files = warc.write_warc(frame.coalesce(1), str(tmp_path / "out"), file_bytes=1 << 10).collect()
    assert len(files) > 1 and sum(f.records for f in files) == len(PAGES)
    whole = b"".join(gzip.open(f.path).read() for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: re") == len(PAGES)
    assert b"a%0D%0AWARC-Type: x%25" in whole and b"\r\nWARC-Type: x" not in whole


@pytest.mark.parametrize("range_bytes", [97, 1000, 1 << 20])
def test_ranges_own_each_record_once(spark, tmp_path, range_bytes):
    """Archives inside payloads, stored uncompressed, junk between members and broken members."""
    def member(record, level=6):
        return gzip.compress(record, compresslevel=level)

    def record(kind, payload):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    rng = random.Random(range_bytes)
    inner = b"".join(member(record("resource", f"inner {i}".encode())) for i in range(30))
    payloads, parts = [], []
    for i in range(40):
        payload = (inner[:rng.randrange(len(inner))] if i % 8 == 7 else inner) if i % 4 == 3 else rng.randbytes(rng.randrange(300))
        payloads.append(payload)
        parts.append(member(record("resource", payload), 0 if i % 4 == 3 else 6))
        if i % 5 == 0:
            parts.append(rng.choice([b"junk", warc.MAGIC + b"junk", member(b"no archive"), member(record("x", b"broken"))[:-3]]))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    got = warc.read_warc(spark, files, range_bytes=range_bytes).orderBy("offset").collect()
    assert [bytes(r.payload) for r in got] == payloads
    assert {r.warc_type for r in got} == {"resource"} and all(r.end > r.offset for r in got)
