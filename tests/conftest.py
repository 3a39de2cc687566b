import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from surveyspark.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


SMOKE = "/root/testdata/sf0.001"
