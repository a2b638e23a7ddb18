"""How a set of document filters interact: what each removes in every order of applying them.

Five filters give each document a mask of the filters it fails.  All that an
order of filters can do to a part of the corpus follows from the part's 32
mask counts, so documents are counted by (part, mask) and the orders are
worked out on the counts.  A Gray-code walk visits all 32 subsets of active
filters, toggling one filter at a time: every mask cell holds the number of
its active failures, and a cell leaves the running survivors when that number
becomes one and returns when it becomes zero.  The 32 states are stored; a
step of an order is the difference of two of them.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import prepare, staged, text_of

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]"
#: Parts whose rows (600 each) are built at once.
_PARTS_AT_ONCE = 50

_ROWS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def _bit(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))


def failure_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    parts = F.split(text, f"{_SPACE}+")
    # a leading, a trailing and the only part can be empty; all other parts are words
    spaces = [9, 10, 11, 12, 13, 32]
    leads, trails = F.ascii(text).isin(spaces), F.ascii(F.right(text, F.lit(1))).isin(spaces)
    empty = text == ""
    n_words = F.size(parts) - leads.cast("int") - trails.cast("int") - empty.cast("int")
    n_distinct = F.size(F.array_distinct(parts)) - (leads | trails | empty).cast("int")
    n_upper = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (_bit(n_words < MIN_WORDS, "A")
            + _bit(n_distinct.cast("long") * 100 < n_words.cast("long") * MIN_DISTINCT_PERCENT, "B")
            + _bit(n_upper.cast("long") * 100 > F.length(text).cast("long") * MAX_UPPER_PERCENT, "C")
            + _bit(text.rlike(SYMBOLS), "D"))


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of active filters.

    ``cells`` has the axes part, mask, measure; the result has part, subset, measure.
    """
    masks = np.arange(cells.shape[1])
    states = np.empty_like(cells)
    active_failures = np.zeros(len(masks), dtype=np.int64)
    survivors = cells.sum(axis=1)
    states[:, 0] = survivors
    subset = 0
    for k in range(1, len(masks)):
        toggled = k & -k  # the bit in which the k-th Gray code differs from the one before
        subset ^= toggled
        failing = masks[(masks & toggled) != 0]
        if subset & toggled:
            gone = failing[active_failures[failing] == 0]
            active_failures[failing] += 1
            survivors = survivors - cells[:, gone].sum(axis=1)
        else:
            active_failures[failing] -= 1
            back = failing[active_failures[failing] == 0]
            survivors = survivors + cells[:, back].sum(axis=1)
        states[:, subset] = survivors
    return states


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders with, for each order and step, the filter's number and the subset active before it."""
    orders = list(permutations(range(len(FILTERS))))
    names = ["".join(FILTERS[f] for f in order) for order in orders]
    filters = np.array(orders)
    before = np.cumsum(1 << filters, axis=1) - (1 << filters)
    return names, filters, before


def _audit(batches):
    names, filters, before = _orders()
    bits = 1 << filters
    n_orders, n_steps = filters.shape
    order_column = pa.array(np.repeat(names, n_steps))
    step_column = pa.array(np.tile(np.arange(1, n_steps + 1), n_orders), pa.int32())
    for batch in batches:
        for at in range(0, batch.num_rows, _PARTS_AT_ONCE):
            some = batch.slice(at, _PARTS_AT_ONCE)
            cells = np.zeros((some.num_rows, 1 << len(FILTERS), 3), dtype=np.int64)
            for i, found in enumerate(some.column(1).to_pylist()):
                for cell in found:
                    cells[i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            states = gray_walk(cells)
            after = states[:, before | bits]
            lost = states[:, before] - after
            fails = states[:, :1, 0] - states[:, 1 << np.arange(len(FILTERS)), 0]
            total = np.stack([lost[:, filters == f, 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
            columns = [after[..., 0], lost[..., 0], fails[:, filters] - lost[..., 0], cells[:, bits, 0], lost[..., 1],
                       lost[..., 2], total[:, filters]]
            rows = n_orders * n_steps
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), rows))),
                 pa.concat_arrays([order_column] * some.num_rows), pa.concat_arrays([step_column] * some.num_rows),
                 *(pa.array(c.reshape(-1), pa.int64()) for c in columns)],
                names=[field.split()[0] for field in _ROWS.split(", ")])


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """Documents of each part and failure mask: (part, mask, n, good, toxic).

    Filter E fails where a smaller id has the identical text, wherever in the
    table.  Texts are compared by SHA-256.  A null text is empty, a null part
    the empty string.  A row without id is neither larger nor smaller than
    any: it passes E, makes no other row fail, and has no label.  Rows that
    share an id and a text both pass or both fail.  A document is good (toxic)
    if any label row of its id has quality (toxic) 1.  Other columns are
    ignored.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text = text_of(docs, text_col)
    found = staged(docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("t"))
        .select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), failure_mask(F.col("t")).alias("mask")), "failures")
    named = found.where("id is not null")
    # One row for each text joined on text and id, so a text with many copies meets one row only
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    known = (labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    repeats = F.when(F.col("is_first"), 0).otherwise(_bit(F.lit(True), "E"))
    marked = (named.join(first, ["digest", "id"], "left").join(known, "id", "left")
              .select("part", (F.col("mask") + repeats).alias("mask"), "good", "toxic"))
    nameless = found.where("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return marked.unionByName(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Every step of every order of the five filters, for each part of the documents.

    See ``failure_cells`` for odd rows.  At most 32 cells of a part meet in a
    task, whatever its number of documents.
    """
    cells = failure_cells(docs, labels, **columns)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(_audit, _ROWS)
