"""Odd ids and column names in the pipeline's stages."""

from collections import Counter

import corpus_pipeline

WORDS = [f"w{i}" for i in range(80)]
LONG, OTHER = " ".join(WORDS), " ".join(f"x{i}" for i in range(80))
NEAR = " ".join(WORDS[:-1] + ["changed"])


def test_duplicates_are_told_by_id_and_text(spark):
    rows = [(1, LONG, "a"), (1, OTHER, "a"), (1, LONG, "b"), (2, NEAR, "a"), (None, LONG, "a"), (None, "only " + OTHER[:200], "a"),
            (None, "only " + OTHER[:200], "z"), (7, None, "a"), (7, "", "a"), (8, " ", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    kept = Counter((r["doc_id"], r["text"]) for r in got)
    assert kept == Counter([(1, LONG), (1, OTHER), (None, "only " + OTHER[:200]), (7, None), (7, ""), (8, " ")])
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(5, "source"), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(i, LONG + f" {i}", "s", "keep", "me") for i in range(6)],
                                 "doc_id long, text string, source string, col string, digest string")
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and {r["col"] for r in mixed.collect()} == {"keep"}
    once = corpus_pipeline.near_duplicates(spark, docs, "")
    assert once.columns == docs.columns and {r["digest"] for r in once.collect()} == {"me"}
