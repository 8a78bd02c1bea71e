import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from papertrail.session import local_session
    s = local_session(cpus=4, shuffle_partitions=4, app="papertrail-tests")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
