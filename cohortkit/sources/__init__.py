"""Sources and sinks (parquet scans with pushed predicates, table writes)."""

from cohortkit.sources.tables import (  # noqa: F401
    describe_table, read_source, read_table, read_written, write_table,
)
from cohortkit.sources import roles  # noqa: F401
