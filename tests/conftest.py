import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortkit.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[2]", app="cohortkit-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
