"""The SQL of the quality rules on languages without a word list, and the R-tree over many blocks."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortkit.llm import ngram_jaccard
from cohortkit.llm.queries import ORACLE, QUERIES

WORDS = {
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у который так сказать же от бы тот мочь год дом".split(),
    "pt": "o a os as de do da que em um uma para com não por mais como mas foi ao ele das tem seu sua ou ser quando muito casa não é".split(),
    "zz": "你好 世界 我们 他们 今天 明天 学校 老师 学生 图书 城市 国家".split(),
    "en": "the of and to in a is that it for was on as with be by house river stone garden window table".split(),
}


def test_sql_follows_the_query_on_every_language(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for lang, n in (("ru", 30), ("pt", 40), ("zz", 25), ("en", 30), (None, 30)):
        for _ in range(n):
            words = rng.choices(WORDS[lang or "pt"], k=rng.randrange(90, 300))
            rows.append((len(rows), " ".join(words) + rng.choice([".", "!", " 12", "\n"]), lang))
    rows += [(len(rows) + k, t, g) for k, (t, g) in enumerate([("слово " * 150, "pt"), ("word " * 150, "ru"), ("1 2 3 " * 80, "ru"),
                                                                ("αβγ δεζ " * 90, "el"), (None, "ru"), ("", None), ("# $ " * 120, "pt")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op6_quality_rules"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = connection.execute(ORACLE["op6_quality_rules"]).df().sort_values("doc_id")
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-4), c
    kept = got.set_index("doc_id")["kept"]
    assert kept[[r[0] for r in rows if r[2] in ("ru", "pt", "zz") and r[0] < 95 and len(r[1].split()) >= 100]].mean() > 0.0


def test_small_blocks_are_searched_by_one_tree(monkeypatch):
    """Pairs of a tree of many blocks are those within each block."""
    searched = []
    pairs = ngram_jaccard.RTree.pairs
    monkeypatch.setattr(ngram_jaccard.RTree, "pairs", lambda self, other, percent: searched.append(len(self.order)) or pairs(self, other, percent))
    monkeypatch.setattr(ngram_jaccard, "GROUPS", ((None, 16),))
    rng = np.random.default_rng(3)
    n = 400
    block = np.sort(rng.integers(0, 60, n))
    base = rng.poisson(2, (60, 16))
    points = base[block] + (rng.random((n, 16)) < 0.15)
    size = points.sum(axis=1)
    import zlib

    table = pa.table({"block": block, "cid": np.arange(n), "n": size, "label": np.arange(n), "slice": np.zeros(n, int), "i": np.zeros(n, int),
                      "j": np.zeros(n, int), "small": np.ones(n, bool),
                      "point": pa.array([zlib.compress(p.astype("<i4").tobytes()) for p in points], pa.binary())})
    found = ngram_jaccard._search(75, None)(table).to_pydict()
    got = set(zip(found["a"], found["b"]))
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    ok = (175 * bound >= 75 * (size[:, None] + size[None])) & (block[:, None] == block[None])
    ok &= (100 * size[:, None] >= 75 * size[None]) & (100 * size[None] >= 75 * size[:, None])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(ok)) if a < b} and searched == [n]
    few = ngram_jaccard._search(75, 1)(table).to_pydict()
    assert None in few["a"] and {p for p in zip(few["a"], few["b"]) if p[0] is not None} < got
