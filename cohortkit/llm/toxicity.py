"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector is shared by all
ordered thresholds.  x marks which words (runs of letters, A-Z lower-cased)
and word beginnings of PREFIXES bytes a text holds, once more for each count
in COUNTS that they reach, all hashed.  The fit uses at most ``fit_rows`` labelled
documents (a documented bound, taken in a seeded order) and is an accelerated
proximal gradient with an L1 penalty, so chance words get no weight.  Scoring
runs over all documents, whole texts, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import prepare, text_of
from .textwords import LOWER, U64, Hasher, blocks, byte_table, mix, runs

FEATURE_BITS = 18
PREFIXES, COUNTS = (5, 6, 7, 8), (2, 3)
#: Labelled documents used for the fit, at most.
FIT_ROWS = 6000
#: Words of fewer fitted documents have no weight; L1 penalty as a share of the mean loss; steps.
MIN_DOCUMENTS, PENALTY, STEPS = 5, 4e-4, 150

_LETTERS = byte_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def _features(hasher: Hasher, texts: pa.Array):
    """Yield (first row, number of texts, text and feature of each set pair, sorted by text) by blocks of texts."""
    for first, data, offsets in blocks(texts):
        starts, ends = runs(_LETTERS[data], offsets)
        lowered = LOWER[data]
        text = np.searchsorted(offsets, starts, side="right") - 1
        hashes, of_text = [hasher.ranges(lowered, starts, ends)], [text]
        for n in PREFIXES:
            longer = ends - starts > n
            hashes.append(mix(hasher.ranges(lowered, starts[longer], starts[longer] + n) + U64(n)))
            of_text.append(text[longer])
        key = (np.concatenate(of_text) << FEATURE_BITS) | (np.concatenate(hashes) >> U64(64 - FEATURE_BITS)).astype(np.int64)
        pairs, count = np.unique(key, return_counts=True)
        low = U64((1 << FEATURE_BITS) - 1)
        more = []
        for n in COUNTS:
            reached = pairs[count >= n]
            again = mix((reached.view(U64) & low) + U64(n << FEATURE_BITS)) >> U64(64 - FEATURE_BITS)
            more.append((reached >> FEATURE_BITS << FEATURE_BITS) | again.astype(np.int64))
        pairs = np.unique(np.concatenate([pairs, *more]))
        yield first, len(offsets) - 1, pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)


def _sets(batches):
    hasher = Hasher()
    for batch in batches:
        out = []
        for _, n, text, features in _features(hasher, batch.column(1)):
            cuts = np.searchsorted(text, np.arange(n + 1))
            out += [features[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["grade", "features"])


@dataclass
class OrdinalModel:
    """weights by feature, and ascending thresholds between grades 0, 1, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit_ordinal(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int) -> OrdinalModel:
    """Fit from the (row, feature) pairs that are set.

    Without two different grades nothing can be learnt: all weights are 0 and
    the thresholds put every text into the grade seen (0 without any).
    """
    seen = np.unique(grades)
    if len(seen) < 2:
        only = int(seen[0]) if len(seen) else 0
        return OrdinalModel(np.zeros(n_features), np.where(np.arange(n_grades - 1) < only, -20.0, 20.0))
    n = len(grades)
    documents = np.bincount(features, minlength=n_features)
    keep = documents[features] >= MIN_DOCUMENTS
    used, features = np.unique(features[keep], return_inverse=True)
    rows = rows[keep]
    # a feature's size is its log odds between the lowest grade seen and the others: telling features are penalised less
    high = grades > seen[0]
    with_high = np.bincount(features, high[rows], minlength=len(used))
    with_low = np.bincount(features, minlength=len(used)) - with_high
    scale = np.abs(np.log((with_high + 1) / (high.sum() + 2)) - np.log((with_low + 1) / ((~high).sum() + 2)))
    size = scale[features]
    # thresholds start at the grades' log odds and stay apart by positive gaps
    above = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1 / (2 * n), 1 - 1 / (2 * n))
    start = np.log((1 - above) / above)
    theta0 = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])

    def thresholds(p):
        return np.cumsum(np.concatenate([p[:1], np.exp(p[1:])]))

    def loss_grad(w, p):
        score = np.bincount(rows, w[features] * size, minlength=n)
        t = np.concatenate([[-np.inf], thresholds(p), [np.inf]])
        low, high = t[grades] - score, t[grades + 1] - score
        with np.errstate(over="ignore"):
            a, b = 1 / (1 + np.exp(-high)), 1 / (1 + np.exp(-low))
        share = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / share, b * (1 - b) / share
        d_score = da - db  # derivative of -log(share) by the score
        d_t = np.zeros(len(t))
        np.add.at(d_t, grades + 1, -da)
        np.add.at(d_t, grades, db)
        d_t = d_t[1:-1] / n
        d_p = np.concatenate([[d_t.sum()], [np.exp(p[k]) * d_t[k:].sum() for k in range(1, len(p))]])
        return -np.log(share).mean(), np.bincount(features, d_score[rows] * size, minlength=len(used)) / n, d_p

    w = v = np.zeros(len(used))
    p = q = theta0
    t, step = 1.0, 1.0
    for _ in range(STEPS):
        loss, gw, gp = loss_grad(v, q)
        while True:  # backtracking
            new_w = v - step * gw
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * PENALTY, 0)
            new_p = q - step * gp
            dw, dp = new_w - v, new_p - q
            if loss_grad(new_w, new_p)[0] <= loss + gw @ dw + gp @ dp + (dw @ dw + dp @ dp) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, q = new_w + (t - 1) / t_new * (new_w - w), new_p + (t - 1) / t_new * (new_p - p)
        w, p, t = new_w, new_p, t_new
        step *= 1.1
    weights = np.zeros(n_features)
    weights[used] = w * scale
    return OrdinalModel(weights, thresholds(p))


def train(docs: DataFrame, grades: DataFrame, n_grades: int, fit_rows: int = FIT_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on the documents with a grade (id, grade from 0); an id's largest grade counts, null ones do not.

    At most ``fit_rows`` ids, first in the order of a hash of the id, are used.
    """
    prepare(docs.sparkSession)
    known = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    # at most fit_rows rows, whatever the data
    labelled = slim.join(F.broadcast(chosen), "doc_id").select(F.col("grade").cast("int").alias("grade"), "text")
    # ids that repeat can make more rows: of those the first in a fixed order, so that every run takes the same
    found = labelled.mapInArrow(_sets, "grade int, features binary")
    rows = found.orderBy(F.xxhash64("grade", "features"), "grade", "features").limit(2 * fit_rows).collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["features"])))
    sets = [np.frombuffer(r["features"], dtype=np.uint32) for r in rows]
    features = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
    return fit_ordinal(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), features,
                       np.array([r["grade"] for r in rows], dtype=np.int64), 1 << FEATURE_BITS, n_grades)


def _score(shared):
    def run(batches):
        hasher, model = Hasher(), OrdinalModel(*shared.value)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for row, n, text, features in _features(hasher, batch.column(1)):
                score[row:row + n] = np.bincount(text, model.weights[features], minlength=n)
            above = model.grades(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((above > 0.5).sum(axis=1), pa.int32()), pa.array(above.sum(axis=1)), pa.array(above[:, 0])],
                names=["doc_id", "grade", "expected_severity", "p_toxic"])
    return run


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, grade (the largest that is more likely reached than not), expected_severity and p_toxic of every row.

    A null or blank text has no features and gets the thresholds' own
    probabilities.  Repeated rows are scored alike; other columns are ignored.
    """
    prepare(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2 ** FEATURE_BITS weights
    return slim.mapInArrow(_score(shared), "doc_id long, grade int, expected_severity double, p_toxic double")
