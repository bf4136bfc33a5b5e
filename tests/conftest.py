import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import local_session

    s = local_session("*", shuffle_partitions=8, app="cohortlens-tests")
    yield s
    from cohortlens.session import drop_materialized

    drop_materialized(s)
    s.stop()
