"""Study parameters as one frozen value object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StudyConfig:
    """Parameters of a cohort study.

    Months are ``'yyyy-MM'`` strings.  ``lookback_months`` follows the
    reference convention: the window starts ``lookback_months + 1`` whole
    months before the anchor month and ends just before it.
    """

    first_month: str = "1995-01"
    study_start: str = "1999-10"
    study_end: str = "2001-08"
    lookback_months: int = 24
    lag_months: int = 2
    target_product: str = "Brand#12"
    named_products: tuple[str, ...] = (
        "Brand#12", "Brand#13", "Brand#14", "Brand#15", "Brand#21",
    )
    product_groups: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("GROUP_A", ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6")),
        ("GROUP_B", ("Brand#7", "Brand#8", "Brand#9")),
    )
    as_of_date: str = "2001-08-31"
    train_end: str = "2001-03"
    seed: int = 42
    bucket_edges: tuple[int, ...] = (1, 3, 6, 9, 12)
    trailing_sizes: tuple[int, ...] = (1, 3, 6, 9, 12)
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def study_start_date(self) -> str:
        return f"{self.study_start}-01"

    @property
    def study_end_date(self) -> str:
        """Last day of the study end month."""
        y, m = (int(x) for x in self.study_end.split("-"))
        import calendar

        return f"{self.study_end}-{calendar.monthrange(y, m)[1]:02d}"


# Parameters used on the driver's TPC-H-ish test tables (FIXTURES.md §C).
TEST_CONFIG = StudyConfig()
