"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.session import checkpoint_dir, shared_path

#: Rows of one Arrow batch sent to a Python task.  Bounds the task's memory
#: when texts are long.
ARROW_ROWS = 1000
#: A table of a known number of small rows has a task for so many, and not fewer tasks than this.
TASK_ROWS, LEAST_TASKS = 5000, 8


def prepare(spark: SparkSession) -> None:
    """Session settings that every operator here relies on."""
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that is removed when the driver's JVM ends."""
    return shared_path(spark, "llm", name)


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a re-read of files instead of a re-run of the
    stages behind them.  ``rows``, where it is known that there are no more,
    keeps a small table from being dealt to many tasks and files; a large one
    keeps the tasks that it has.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column as a string; null is the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))
