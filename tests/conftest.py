import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, driver_memory="4g")
    yield s


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="tessera-test-")
