"""Table scans and writes.

``read_table`` is the replacement for a pushed-down warehouse query: it
selects only the named columns and applies the predicate on the scan so
Catalyst pushes it into the parquet reader (``PushedFilters``) and prunes
the ``ReadSchema``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None,
               where: Column | str | None = None) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet`` with projection and predicate pushdown."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if where is not None:
        df = df.filter(F.expr(where) if isinstance(where, str) else where)
    if columns:
        df = df.select(*columns)
    return df


# name used by callers of the reference's warehouse reader
read_source = read_table


def date_window(df: DataFrame, col: str, start: str | None, end: str | None) -> Column:
    """Inclusive date window (both ends kept) on a raw date/timestamp column.

    Bounds are literals cast to the column's own type, so the comparison is
    pushed into the parquet reader (``PushedFilters``) and prunes row
    groups; the end bound covers the whole last day.
    """
    import datetime as dt

    typ = df.schema[col].dataType
    cond = F.lit(True)
    if start:
        cond = cond & (F.col(col) >= F.lit(start).cast(typ))
    if end:
        nxt = (dt.date.fromisoformat(end) + dt.timedelta(days=1)).isoformat()
        cond = cond & (F.col(col) < F.lit(nxt).cast(typ))
    return cond


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite",
                fmt: str = "parquet", header: bool = True) -> str:
    """Overwrite a table in one step; errors propagate (never swallowed)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", str(header).lower()).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def read_written(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read
    if fmt == "csv":
        r = r.option("header", "true")
        if schema is not None:
            r = r.schema(schema)
        return r.csv(path)
    return r.format(fmt).load(path)


def describe_table(df: DataFrame) -> DataFrame:
    """One row per column with its position, name, type, the table's rows and the non-null values; one pass."""
    fields = [F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("data_type"),
                       F.count(F.lit(1)).alias("n_rows"), F.count(F.col(f"`{n}`")).alias("n_values"))
              for i, (n, t) in enumerate(df.dtypes)]
    return df.agg(F.array(*fields).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")
