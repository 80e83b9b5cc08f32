import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fairlease.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=4, app="fairlease-tests")
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="fairlease-test-ckpt-")
        s.sparkContext.setCheckpointDir(d)
    yield s


SF_SMALL = "/root/testdata/sf0.001"
