"""Packing pieces of documents into sequences by length patterns.

Only the histogram of lengths (at most ``capacity`` numbers, whatever the
data) reaches the driver.  Patterns of few lengths that nearly fill a sequence
are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down to what the histogram holds, and
the residual is packed largest first, each time repeating the pattern as often
as its lengths last.  Every piece then finds its sequence from its number
among the pieces of its length; those numbers come from counts by task, so no
length, however common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import prepare, staged, text_of
from .tokens import PieceTokenizer, default_path

CAPACITY = 2048
SEPARATOR_ID = 0
#: A pattern may leave this many tokens of a sequence empty.
MAX_WASTE = 4
#: Longest pattern enumerated before the fit, and how many next lengths are tried at each place.
PATTERN_LENGTH, BRANCHES = 4, 2
NNLS_STEPS = 400


def enumerate_patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Descending tuples of up to PATTERN_LENGTH available lengths that fill a sequence to within MAX_WASTE.

    After each length the next are the largest that fit, and the largest up to
    half of the space, so every length is in some pattern with short and long
    partners.
    """
    found: set[tuple[int, ...]] = set()

    def extend(pattern: tuple[int, ...], space: int) -> None:
        if space <= MAX_WASTE:
            found.add(pattern)
        if len(pattern) == PATTERN_LENGTH:
            return
        for most in (space, space // 2) if len(pattern) + 1 < PATTERN_LENGTH else (space,):
            top = bisect_right(lengths, min(most, pattern[-1]))
            for length in lengths[max(0, top - BRANCHES):top]:
                extend((*pattern, length), space - length)

    for length in lengths:
        extend((length,), capacity - length)
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares of the patterns' repeat counts against the histogram (accelerated projected gradient)."""
    rows = np.fromiter((length for p in patterns for length in p), np.int64)
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])

    def used(x):
        return np.bincount(rows, x[cols], minlength=len(histogram))

    def back(r):
        return np.bincount(cols, r[rows], minlength=len(patterns))

    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue, for the step
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(NNLS_STEPS):
        new = np.maximum(0.0, y - back(used(y) - histogram) / (1.05 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_patterns(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram (index: length) exactly."""
    left = np.asarray(histogram, dtype=np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], wanted: int) -> int:
        lengths, times = np.unique(pattern, return_counts=True)
        n = int(min(wanted, (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            plan.append((pattern, n))
        return n

    lengths = np.flatnonzero(left).tolist()
    patterns = enumerate_patterns(lengths, capacity)
    if patterns:
        counts = fit_counts(patterns, left.astype(float))
        for k in np.argsort(-counts, kind="stable"):
            take(patterns[k], int(counts[k]))
    while lengths:
        while lengths and left[lengths[-1]] == 0:
            lengths.pop()
        if not lengths:
            break
        pattern, space, top = [], capacity, len(lengths)
        while True:
            top = bisect_right(lengths, space, 0, top)
            while top and left[lengths[top - 1]] <= pattern.count(lengths[top - 1]):
                top -= 1
            if not top:
                break
            pattern.append(lengths[top - 1])
            space -= lengths[top - 1]
        take(tuple(pattern), int(left.max()))
        lengths = [x for x in lengths if left[x]]
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """By length and first number: where the pieces of that length go (keys, numbers, sequences, offsets)."""
    segments, first, taken = [], 0, {}
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            start = taken.get(length, 0)
            segments.append((length, start, first, offset))
            taken[length] = start + n
            offset += length
        first += n
    segments.sort()
    table = np.array(segments, dtype=np.int64).reshape(-1, 4)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def _number(batches):
    """Adds the task and each row's number among the task's rows of its length; rows: (..., length)."""
    part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        if len(length) and length.max() >= len(seen):
            seen = np.r_[seen, np.zeros(int(length.max()) + 1 - len(seen), np.int64)]
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        run_start = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1] if len(length) else np.zeros(0, np.int64)
        run_size = np.diff(np.r_[run_start, len(ordered)])
        number = np.empty(len(length), np.int64)
        number[order] = np.arange(len(length)) - np.repeat(run_start, run_size) + seen[ordered]
        seen[ordered[run_start]] += run_size
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(number)],
            names=[*batch.schema.names, "part", "number"])


def _assign(plan):
    def run(batches):
        keys, numbers, sequences, offsets = plan.value
        for batch in batches:
            names = batch.schema.names
            length, number = (batch.column(names.index(c)).to_numpy() for c in ("length", "place_number"))
            k = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            kept = [i for i, c in enumerate(names) if c != "place_number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sequences[k] + number - numbers[k]), pa.array(offsets[k])],
                names=[*(names[i] for i in kept), "sequence_id", "offset"])
    return run


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack rows with a long column ``length`` (1 to ``capacity``) into sequences of at most ``capacity``.

    Returns the rows with sequence_id and offset (both long): the pieces of a
    sequence lie behind one another without gaps.  ``pieces`` must not hold
    columns named part, number, place_number, sequence_id or offset.  An empty
    table gives no rows; rows may repeat.
    """
    prepare(pieces.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return _placed(pieces.mapInArrow(_number, f"{schema}, part int, number long"), schema, capacity)


def _placed(numbered: DataFrame, schema: str, capacity: int) -> DataFrame:
    """The rows that ``_number`` made of rows of the schema, with sequence_id and offset."""
    spark, columns = numbered.sparkSession, numbered.columns[:-2]
    numbered = staged(numbered, "pieces")
    counts = staged(numbered.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(_places(plan_patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = (numbered.join(base, ["part", "length"])
              .select(*[F.col(f"`{c}`") for c in columns], (F.col("base") + F.col("number")).alias("place_number")))
    return placed.mapInArrow(_assign(plan), f"{schema}, sequence_id long, offset long")


def _cut(path: str, capacity: int, separator: int, with_ids: bool):
    def run(batches):
        tokenizer = PieceTokenizer.of_process(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(separator))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    for values, v in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), part)):
                        values.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(v, k) for v, k in zip(out, kinds)]
            if with_ids:
                columns.append(pa.array(out[5], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])
    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR_ID, with_ids: bool = False,
                 tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and the separator, cut into pieces of ``capacity`` where longer.

    A null text is empty: one piece of the separator.  A null id stays null;
    repeated rows give repeated pieces.  Other columns are ignored.
    """
    prepare(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return slim.mapInArrow(_cut(tokenizer_path or default_path(), capacity, separator, with_ids), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The documents' pieces (see ``token_pieces``) with sequence_id and offset (see ``best_fit_pack``)."""
    return best_fit_pack(token_pieces(docs, capacity, with_ids=with_ids), capacity)


#: Between the cut and the sequences ids travel as bytes, two for each where the vocabulary allows.
_NARROW = 1 << 16


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as little-endian bytes: two for each, or four where one is too large."""
    return ids.astype("<u2" if not len(ids) or ids.max() < _NARROW else "<u4").tobytes()


def _cut_numbered(path: str, capacity: int, separator: int):
    """``_cut`` with ids in bytes and ``_number`` in one Python task, so that a tokenizer is held once for each."""
    def cut(batches):
        tokenizer = PieceTokenizer.of_process(path)
        for batch in batches:
            out: list[list] = [[] for _ in _PIECES]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(separator))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    for values, v in zip(out, (doc_id, piece, start, len(part), _narrow(part))):
                        values.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=list(_PIECES))
    return lambda batches: _number(cut(batches))


def _opened(batches):
    """Ids as a list column again, with a checksum taken from the ids as packed."""
    for batch in batches:
        names = batch.schema.names
        data, length = batch.column(names.index("ids")).to_pylist(), batch.column(names.index("length")).to_pylist()
        parts = [np.frombuffer(d, "<u2" if len(d) == 2 * n else "<u4").astype("<u4") for d, n in zip(data, length)]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        ids = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        columns = dict(zip(names, batch.columns))
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
        columns["ids_crc32"] = pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())
        yield pa.RecordBatch.from_arrays([columns[c] for c in _SEQUENCES], names=list(_SEQUENCES))


_PIECES = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids": "binary"}
_SEQUENCES = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long",
              "offset": "long", "ids": "array<int>"}


def pack_sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents' sequences with their tokens: pieces as of ``pack_documents`` with ``ids`` and the checksum of these.

    The rows of a sequence lie behind one another in one partition, by offset,
    so a sequence's ids are those of its rows, joined.
    """
    prepare(docs.sparkSession)
    schema = ", ".join(f"{c} {k}" for c, k in _PIECES.items())
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    numbered = slim.mapInArrow(_cut_numbered(default_path(), capacity, SEPARATOR_ID), f"{schema}, part int, number long")
    placed = _placed(numbered, schema, capacity).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return placed.mapInArrow(_opened, ", ".join(f"{c} {k}" for c, k in _SEQUENCES.items()))
