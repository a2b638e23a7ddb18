"""Registered queries over the provided test tables.

Each plan module registers ``name -> (spark, sf_dir) -> DataFrame`` and, where
SQL can express it, the equivalent DuckDB SQL used as the correctness oracle.
"""

from cohortkit.plans.registry import QUERIES, ORACLE, load_all  # noqa: F401
