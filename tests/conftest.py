import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
AS_OF = "2024-05-01 12:00:00"


@pytest.fixture(scope="session")
def spark():
    from flowlens.session import get_session
    s = get_session("local[4]", app="flowlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from flowlens.plans.check import duck_connect
    return duck_connect(SF_SMALL)
