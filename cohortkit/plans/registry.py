"""Query registry shared by all plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PLAN_MODULES = [
    "cohortkit.plans.cohort_plans",
    "cohortkit.plans.quality_plans",
    "cohortkit.plans.panel_plans",
    "cohortkit.plans.feature_plans",
    "cohortkit.plans.timeline_plans",
    "cohortkit.plans.master_plans",
    "cohortkit.plans.model_plans",
]


def load_all() -> None:
    for m in PLAN_MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:  # a plan module not written yet
            if e.name != m:
                raise


def finalize(df: DataFrame) -> DataFrame:
    """Normalise output types so both engines agree on the schema.

    integers -> bigint, float/decimal -> double rounded to 6 places,
    date -> 'yyyy-MM-dd', timestamp -> 'yyyy-MM-dd HH:mm:ss', boolean -> bigint.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    """Decorator: register a plan (wrapped in ``finalize``) and its oracle SQL."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # dates are derived from timestamps: pin the zone whatever session runs us
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finalize(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn

    return deco


ORACLE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _normalize_expr(name: str, duck_type: str) -> str:
    """DuckDB twin of ``finalize`` for one output column."""
    q = '"' + name.replace('"', '""') + '"'
    t = duck_type.upper()
    if t.startswith(("DOUBLE", "FLOAT", "REAL", "DECIMAL", "NUMERIC")):
        return f"round(CAST({q} AS DOUBLE), 6) AS {q}"
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER",
             "UBIGINT", "BOOLEAN"):
        return f"CAST({q} AS BIGINT) AS {q}"
    if t == "DATE":
        return f"strftime({q}, '%Y-%m-%d') AS {q}"
    if t.startswith("TIMESTAMP"):
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S') AS {q}"
    return q


def normalized_oracle(sf_dir: str) -> dict[str, str]:
    """Oracle SQL wrapped so its output types match ``finalize``: doubles
    rounded to 6 places, integers as BIGINT, dates as strings.

    Column types come from DuckDB ``DESCRIBE`` (planning only) on the tables
    of ``sf_dir``; when DuckDB or the tables are unavailable the raw SQL is
    returned.
    """
    import os

    try:
        import duckdb
    except ImportError:  # pragma: no cover
        return dict(ORACLE)
    con = duckdb.connect()
    for t in ORACLE_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    out = {}
    for name, sql in ORACLE.items():
        try:
            cols = con.execute(f"DESCRIBE {sql}").fetchall()
        except Exception:  # noqa: BLE001 - keep the raw SQL if it cannot be described
            out[name] = sql
            continue
        exprs = ", ".join(_normalize_expr(c[0], c[1]) for c in cols)
        out[name] = f"SELECT {exprs} FROM (\n{sql}\n) AS _oracle"
    con.close()
    return out
