"""Token ids in Parquet: a list column of ids beside small metadata columns.

Files are dealt by ranges of the document id and sorted inside, so page
indexes on the id let a reader fetch single documents, and the metadata
columns can be read without the ids.  Ids are dictionary encoded (the
vocabulary fits one dictionary page), metadata delta encoded; row groups and
pages have set sizes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import new_table_path, prepare, text_of
from .tokens import PieceTokenizer, default_path

END_ID = 2
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "false",  # version 2 then delta encodes numbers
    "parquet.enable.dictionary#ids.list.element": "true",
}


def _tokenize(path: str, end_id: int):
    def run(batches):
        tokenizer = PieceTokenizer.of_process(path)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in tokenizer.encode(batch.column(1))]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            starts = start + np.cumsum(count) - count
            start += int(count.sum())
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(flat.view(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(count, pa.int64()), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, end it with ``end_id`` and write the ids to ``path`` in ascending id order.

    A null text is empty: its only id is the end.  Rows with one id are
    ordered by text; a null id comes last.  An empty table gives no rows.
    Other columns are ignored.
    """
    prepare(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    dealt = slim.repartitionByRange(order).sortWithinPartitions(order, "text")
    encoded = dealt.mapInArrow(_tokenize(tokenizer_path or default_path(), end_id),
                               "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    encoded.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written table with ``start``: the number of ids before the document."""
    table = spark.read.parquet(path)
    # one row for each task that wrote: at most spark.sql.shuffle.partitions, so small enough to broadcast
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return table.join(F.broadcast(first), F.col("part") == F.col("p")).select(
        "doc_id", (F.col("first") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column(3)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) -> the checksum of the ids as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    path = new_table_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path)
