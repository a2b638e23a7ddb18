"""cohortkit: a Spark-native cohort, feature and propensity engine.

Every operator is a lazily composed ``DataFrame -> DataFrame`` function built
from Spark SQL functions, joins, aggregates and windows.  Nothing is collected
to the driver except explicitly bounded check results (offender samples,
metric rows, model coefficients).
"""

from cohortkit.config import StudyConfig, TEST_CONFIG

__all__ = ["StudyConfig", "TEST_CONFIG"]
