"""Connected components: rounds, shapes and the Jaccard join of many versions of one text."""

import random

import pytest

from cohortkit.llm import components, ngram_jaccard


def found(spark, links, schema="a long, b long"):
    rows = components.connected_components(spark.createDataFrame(links, schema)).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["label"] for r in rows}


def expected(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def test_shapes(spark):
    rng = random.Random(4)
    links = [(7, 7), (None, 3), (5, None), (1, 2), (2, 1), (1, 2)]
    links += [(1000, 1000 + i) for i in range(1, 200)]                      # a star around its smallest node
    links += [(2999, 2000 + i) for i in range(200)]                         # and around its largest
    links += [(3000 + rng.randrange(400), 3000 + rng.randrange(400)) for _ in range(300)]
    assert found(spark, links) == expected(links)
    assert found(spark, []) == {}


@pytest.mark.parametrize("order", ["ascending", "shuffled"])
def test_long_paths_take_few_rounds(spark, monkeypatch, order):
    n = 10_000
    names = list(range(n))
    if order == "shuffled":
        random.Random(1).shuffle(names)
    rounds = []
    step = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda edges: rounds.append(1) or step(edges))
    assert set(found(spark, list(zip(names, names[1:]))).values()) == {0}
    assert len(rounds) <= 20


def test_join_of_successive_versions(spark):
    """Each version changes four of a hundred words: neighbours link, far ones do not, and all are one component."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for version in range(300):
        rows.append((version, " ".join(words)))
        for k in range(4):
            words[(4 * version + k) % 100] = f"v{version}.{k}.{rng.randrange(10**6)}"
    result = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).documents
    assert {r["component_id"] for r in result.collect()} == {0}


def test_small_tables_of_the_search_have_few_files(spark, monkeypatch):
    files, write = {}, ngram_jaccard.staged

    def counted(df, name, rows=None):
        files[name] = max(files.get(name, 0), len((out := write(df, name, rows)).inputFiles()))
        return out

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(10 * g + v, " ".join([f"g{g}", *words[g:], f"v{v}"])) for g in range(30) for v in range(3)],
                                 "doc_id long, text string").repartition(40)
    monkeypatch.setattr(ngram_jaccard, "staged", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        labels = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.ngram_jaccard_join(docs).documents.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert all(labels[10 * g + v] == labels[10 * g] for g in range(30) for v in range(3))
    assert files["blocks"] <= 8 and files["points"] <= 8
