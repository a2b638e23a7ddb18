"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from cohortkit.functions.dates import (  # noqa: F401
    month_str, month_index, month_index_of_str, month_from_index, week_start,
    parse_date, parse_date_any, month_before,
)
from cohortkit.functions.exprs import (  # noqa: F401
    any_true, all_true, safe_div, recode_use, null_safe_eq, row_total, r6,
    any_null, any_positive,
)
