import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("QUILLMARK_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quillmark.session import drop_stages, local_session

    s = local_session("*", shuffle_partitions=8, app="quillmark-tests")
    yield s
    drop_stages(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
