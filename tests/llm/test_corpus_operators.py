"""Jaccard join, mixing, packing, token store, toxicity, chat repair and the pipeline against brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortkit.llm import chat_repair, mixing, ngram_jaccard, packing, token_store, toxicity
from cohortkit.llm.components import connected_components
from cohortkit.llm.tokens import PieceTokenizer, default_path


def components_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def expected_components(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return {rows[i][0]: (len(sets[i]), rows[c][0]) for i, c in enumerate(components_of(len(rows), links))}


def joined(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard_join(frame).documents.collect()}


def test_jaccard_join(spark, texts):
    rows = list(texts.items()) + [(10_000, None), (10_001, " \n"), (10_002, "a b"), (10_003, "A  b"), (10_004, "a b c")]
    assert joined(spark, rows) == expected_components(rows)


def near_copies(n, length, edits, seed):
    rng = random.Random(seed)
    origin = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    rows = []
    for k in range(n):
        words = list(origin)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(length)] = f"x{rng.randrange(10_000)}"
        rows.append((seed * 1000 + k, " ".join(words)))
    return rows


def test_jaccard_large_groups(spark, monkeypatch):
    """Blocks larger than a slice, in several components, hot shingles and sets of every point size."""
    monkeypatch.setattr(ngram_jaccard, "SMALL", 8)
    monkeypatch.setattr(ngram_jaccard, "SLICE", 16)
    monkeypatch.setattr(ngram_jaccard, "HOT_LEAST", 20)
    monkeypatch.setattr(ngram_jaccard, "GROUPS", ((50, 8), (200, 16), (None, 64)))
    rows = near_copies(70, 120, 8, 1) + near_copies(40, 45, 4, 2) + near_copies(30, 230, 20, 3)
    rows += [(9000 + k, rows[0][1].split(" ", 3)[3] + f" tail {k}") for k in range(5)]
    assert joined(spark, rows) == expected_components(rows)


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = ngram_jaccard.ngram_jaccard_join(odd_docs).documents.collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by_id[None] == (0, None) and by_id[1] == (0, 1) and by_id[5] == (10, 4) and by_id[8] == (1, 7) and by_id[6] == (1, 6)
    assert ngram_jaccard.ngram_jaccard_join(no_docs).documents.count() == 0


def test_the_sieve_and_what_reads_it_are_one_python_step(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i + 1)) for i in range(40)] + [(None, "nobody")], "doc_id long, text string")
    wanted = spark.createDataFrame([(3,), (17,)], "doc_id long")
    got = ngram_jaccard._sieved(docs, wanted, 2, ngram_jaccard._members(5, False), "cid long, n long, point binary")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    sizes = {r["cid"]: r["n"] for r in got.collect()}
    assert sizes.items() >= {3: 1, 17: 1}.items() and len(sizes) < 10 and max(sizes) >= ngram_jaccard.NO_ID


def test_rtree_bounds():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (150, 16)).astype(np.int64)
    points[75:] = points[:75] + (rng.random((75, 16)) < 0.1)
    sizes = points.sum(axis=1)
    tree = ngram_jaccard.RTree(points, sizes)
    got = {(min(a, b), max(a, b)) for x, y, _ in tree.pairs(tree, 75) for a, b in zip(x.tolist(), y.tolist()) if a != b}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    ok = 175 * bound >= 75 * (sizes[:, None] + sizes[None])
    ok &= (100 * sizes[:, None] >= 75 * sizes[None]) & (100 * sizes[None] >= 75 * sizes[:, None])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(ok)) if a < b}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    expected = components_of(500, links)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: expected[x] for pair in links for x in pair}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def water_filled(sizes, weights, most):
    caps, total = {s: most * n for s, n in sizes.items()}, sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(caps[s] for s in capped)) / max(1, sum(weights[s] for s in free))
        above = {s for s in free if level * weights[s] > caps[s]}
        if not above:
            return {s: caps[s] if s in capped else level * weights[s] for s in sizes}
        capped |= above


def check_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s))
    targets = water_filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - targets[s]) <= largest
    return taken


def test_mixing(docs, odd_docs, no_docs, spark):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(r["size"] == len(r["row"]["text"].encode().split()) for r in rows)
    check_mix(rows)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert {r["row"]["doc_id"]: r["taken"] for r in rows} == {r["row"]["doc_id"]: r["taken"] for r in again}
    check_mix(mixing.mix_sources(odd_docs).collect())
    assert mixing.mix_sources(no_docs).count() == 0
    skewed = spark.createDataFrame([(k, "a b c " * (k % 9 + 1), "big" if k % 50 else f"s{k}") for k in range(400)],
                                   "doc_id long, text string, source string")
    check_mix(mixing.mix_sources(skewed).collect())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD_TEXTS = ["", "don't 'There'S we'LL x.y a.B 12ab3 ÀÉ é ≠ a≠b", "<|endoftext|> a<|startoftext|>B", "   x Y\x85z ",
             "İstanbul ΣΑΣ ſ K", "\x00\x1c a\x1fb", "日本語 text\U0001f600ok", "A" * 5000, "́a .́", "'s's't'reve don' t", "a'é é'S"]


def test_piece_tokenizer_equals_whole(texts, tokenizer):
    rows = [*texts.values(), *ODD_TEXTS]
    got = [x.tolist() for x in PieceTokenizer(default_path()).encode(pa.array(rows))]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_store(spark, texts, tokenizer, odd_docs, no_docs):
    rows = [*texts.items(), (10_000, None), (10_001, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = token_store.round_trip(frame)
    got = {r["doc_id"]: r for r in token_store.token_checksums(store).collect()}
    start = 0
    for k, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    some = store.where("doc_id = 7").first()
    assert some["ids"][:-1] == tokenizer.encode(texts[7], add_special_tokens=False).ids
    assert token_store.round_trip(odd_docs).count() == odd_docs.count()
    assert token_store.round_trip(no_docs).count() == 0


def test_token_store_layout(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_store.write_tokens(docs, str(tmp_path / "t"))
    for path in glob.glob(str(tmp_path / "t" / "*.parquet")):
        columns = {c["path_in_schema"]: c for c in (pq.ParquetFile(path).metadata.row_group(0).column(k).to_dict() for k in range(5))}
        ids = next(v for k, v in columns.items() if k.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids["encodings"])
        assert "DELTA_BINARY_PACKED" in columns["doc_id"]["encodings"]
        assert pq.ParquetFile(path).metadata.row_group(0).column(0).has_column_index


def check_packed(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing(spark, texts, tokenizer, odd_docs, no_docs):
    rows = [*texts.items(), (10_000, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = {}
    for k, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            expected[k, p // 2048] = (p, len(ids[p:p + 2048]), crc(ids[p:p + 2048]))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == expected
    n = check_packed(got, 2048)
    assert n <= 1.03 * -(-sum(r["length"] for r in got) // 2048)
    check_packed(packing.pack_documents(odd_docs).collect(), 2048)
    assert packing.pack_documents(no_docs).count() == 0
    with_ids = packing.pack_documents(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), with_ids=True).first()
    assert with_ids["ids"][-1] == 0 and len(with_ids["ids"]) == with_ids["length"]


def test_packed_sequences_hold_the_tokens(spark, texts, tokenizer, odd_docs, no_docs):
    rows = [*texts.items(), (10_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for packed in (packing.pack_sequences(frame), corpus_pipeline.packing(spark, frame, "")):
        got = packed.collect()
        check_packed(got, 2048)
        sequences = defaultdict(list)
        for a, b in itertools.pairwise(got):  # a sequence's rows lie together, by offset
            assert a["sequence_id"] != b["sequence_id"] or a["offset"] + a["length"] == b["offset"]
        for r in got:
            assert len(sequences[r["sequence_id"]]) == r["offset"]
            sequences[r["sequence_id"]] += r["ids"]
        tokens = defaultdict(list)
        for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
            part = sequences[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
            assert r["start"] == len(tokens[r["doc_id"]]) and r["ids_crc32"] == crc(part)
            tokens[r["doc_id"]] += part
        assert tokens == {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows}
    assert packing.pack_sequences(odd_docs).count() == packing.pack_documents(odd_docs).count()
    assert packing.pack_sequences(no_docs).count() == 0


def test_narrow_ids_come_back():
    names = ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
    for ids in ([0, 65535], [65536, 1], [1 << 30]):
        batch = pa.RecordBatch.from_arrays([pa.array([v]) for v in (1, 0, 0, len(ids), 0, 0, packing._narrow(np.array(ids, np.uint32)))], names=names)
        back = next(packing._opened([batch]))
        assert back.column(back.schema.names.index("ids")).to_pylist() == [ids]


@pytest.mark.parametrize("seed", range(6))
def test_pattern_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.minimum(capacity, 1 + rng.geometric(rng.uniform(0.02, 0.5), 3000))
    np.add.at(histogram, lengths, 1)
    used = np.zeros_like(histogram)
    n = 0
    for pattern, times in packing.plan_patterns(histogram, capacity):
        assert sum(pattern) <= capacity and times > 0
        np.add.at(used, list(pattern), times)
        n += times
    assert (used == histogram).all()
    assert n <= 1.05 * -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity) + 1 or n == int(histogram[capacity // 2 + 1:].sum())


def test_fit_counts_recovers_exact_mix():
    patterns = [(6, 4), (5, 5), (7, 3), (4, 3, 3)]
    wanted = np.array([30.0, 12.0, 0.0, 9.0])
    histogram = np.zeros(11)
    for p, n in zip(patterns, wanted):
        for length in p:
            histogram[length] += n
    assert packing.fit_counts(patterns, histogram) == pytest.approx(wanted, abs=0.2)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(300)]

    def text(grade):
        body = [rng.choice(words) for _ in range(60)] + [rng.choice(["awful", "nasty"]) for _ in range(2 * (grade > 0))]
        body += ["vile"] * (2 * (grade > 1))
        rng.shuffle(body)
        return " ".join(body)

    rows = [(k, text(g), g) for k in range(900) for g in [rng.choice([0, 0, 0, 1, 2])]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.train(frame, frame.where("doc_id < 600").select("doc_id", "grade"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in toxicity.score_documents(frame, model).collect()}
    held = rows[600:]
    assert sum(got[k]["grade"] == g for k, _, g in held) / len(held) > 0.95
    assert all(0 <= r["p_toxic"] <= r["expected_severity"] <= 2 for r in got.values())


def test_toxicity_odd_rows(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = toxicity.train(odd_docs, none, 3)
    scored = toxicity.score_documents(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(r["grade"] == 0 for r in scored)
    assert toxicity.score_documents(no_docs, model).count() == 0
    one = spark.createDataFrame([(4, 2), (4, None), (None, 1)], "doc_id long, grade int")
    assert all(r["grade"] == 2 for r in toxicity.score_documents(odd_docs, toxicity.train(odd_docs, one, 3)).collect())


def legal(roles):
    if roles[:1] == ["system"]:
        roles = roles[1:]
        if not roles:
            return False
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


def cheapest(roles):
    """Brute force over every target role, merge and number of inserted turns."""
    best = None
    for targets in itertools.product(chat_repair.ROLES, repeat=len(roles)):
        change = sum(0 if t == r else chat_repair.UNKNOWN if r not in chat_repair.ROLES else chat_repair.RELABEL
                     for t, r in zip(targets, roles))
        for merged in itertools.product((False, True), repeat=len(roles)):
            if any(m and (k == 0 or targets[k] != targets[k - 1]) for k, m in enumerate(merged)):
                continue
            kept = [t for t, m in zip(targets, merged) if not m]
            cost, out = change + chat_repair.MERGE * sum(merged), []
            for t in kept:
                while not can_follow(out, t) and len(out) < 30:
                    out.append("user" if not out or out[-1] != "user" else "assistant")
                    cost += chat_repair.INSERT
                    if t == "system":
                        break
                out.append(t)
            while not legal(out) and len(out) < 30:
                out.append("user" if not out or out[-1] != "user" else "assistant")
                cost += chat_repair.INSERT
            if legal(out) and (best is None or cost < best):
                best = cost
    return best


def can_follow(out, role):
    last = out[-1] if out else None
    return role in {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[last]


def repaired(spark, conversations):
    rows = [(c, k, r, f"t{k}") for c, roles in conversations.items() for k, r in enumerate(roles)]
    got = defaultdict(list)
    for r in chat_repair.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r["conv_id"]].append(r)
    for turns in got.values():
        turns.sort(key=lambda r: (r["position"], r["seq"]))
    return got


def check_conversation(turns, roles):
    out = []
    for r in turns:
        if r["position"] == len(out):
            out.append(r["role"])
        assert r["position"] == len(out) - 1 and r["role"] == out[-1]
    assert legal(out)
    assert [r["turn"] for r in turns if r["turn"] is not None] == list(range(len(roles)))
    price = {"keep": 0, "merge": chat_repair.MERGE, "insert": chat_repair.INSERT}
    cost = sum(price[r["action"]] if "relabel" not in r["action"] else
               (chat_repair.RELABEL if r["role_before"] in chat_repair.ROLES else chat_repair.UNKNOWN)
               + chat_repair.MERGE * ("merge" in r["action"]) for r in turns)
    assert cost == turns[0]["cost"]
    text = "".join(r["rendered"] for r in turns)
    assert text.count("<|end|>") == len(out) and text.endswith("<|end|>\n")
    assert [x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end")] == out


def test_chat_repair_is_cheapest(spark):
    names = ["system", "user", "assistant", "tool"]
    rng = random.Random(2)
    conversations = dict(enumerate(itertools.chain(
        ([a] for a in names), ([a, b] for a in names for b in names),
        ([rng.choice(names) for _ in range(rng.choice((3, 4)))] for _ in range(40)))))
    for c, turns in repaired(spark, conversations).items():
        check_conversation(turns, conversations[c])
        assert turns[0]["cost"] == cheapest(conversations[c]), conversations[c]


def test_chat_repair_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    conversations = {c: [rng.choice(["user", "assistant", "user", "system", "x"]) for _ in range(60)] for c in range(4)}
    conversations[9] = ["user"] * 40
    whole = {c: turns[0]["cost"] for c, turns in repaired(spark, conversations).items()}
    monkeypatch.setattr(chat_repair, "BLOCK", 7)
    for c, turns in repaired(spark, conversations).items():
        check_conversation(turns, conversations[c])
        assert turns[0]["cost"] == whole[c]


def test_chat_repair_odd_rows(spark):
    rows = [(None, None, None, None, 1), (None, 1, "USER ", "a<|end|>", 1), (1, 1, "user", "", 1), (1, 1, "user", "", 1), (1, None, "assistant", "z", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position long")
    got = chat_repair.repair_roles(frame).collect()
    assert sum(r["action"] != "insert" for r in got) == 5
    assert not any("a<|end|>" in r["rendered"] for r in got)
    assert chat_repair.repair_roles(frame.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, docs, tokenizer):
    from test_text_operators import base_quality, base_spans

    sf_dir = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "personal data", "source mixing", "best-fit packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns
        old = {r["doc_id"]: r for r in before.collect()}
        new = after.collect()
        ids = [r["doc_id"] for r in new]
        if name == "quality rules":
            assert all(not base_quality(r["text"])[5] for r in new) and len(set(ids)) == len(ids)
            assert all(r == old[r["doc_id"]] for r in new)
        elif name == "n-gram Jaccard join":
            groups = expected_components([(k, r["text"]) for k, r in old.items()])
            assert sorted(ids) == sorted({c for _, c in groups.values()})
        elif name == "personal data":
            assert sorted(ids) == sorted(old)
            for r in new:
                assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
                if not base_spans(old[r["doc_id"]]["text"]):
                    assert r["text"] == old[r["doc_id"]]["text"]
        else:
            sizes = {k: len(r["text"].encode().split()) for k, r in old.items()}
            times = Counter(ids)
            check_mix([{"source": r["source"], "size": sizes[k], "times": times[k], "taken": times[k] * sizes[k],
                        "source_size": sum(sizes[j] for j, x in old.items() if x["source"] == r["source"]),
                        "target": None} | targets_of(old, sizes, r["source"]) for k, r in old.items()])
        before = after
    packed = corpus_pipeline.packing(spark, before, sf_dir).collect()
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
    assert sum(r["length"] for r in packed) == total
    check_packed(packed, 2048)


def targets_of(rows, sizes, source):
    by_source = defaultdict(int)
    for k, r in rows.items():
        by_source[r["source"]] += sizes[k]
    names = sorted(by_source, key=lambda s: (s is None, s))
    return {"target": water_filled(by_source, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3)[source]}


def test_pipeline_on_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
