import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from helio.session import local_session
    s = local_session(cores=4, shuffle_partitions=8, app="helio-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def obs(spark):
    from helio.sources.observations import observations
    return observations(spark, SF_SMALL)
