import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from retentio.session import checkpoint_dir, get_spark

    s = get_spark("local[*]", shuffle_partitions=8)
    checkpoint_dir(s, tempfile.mkdtemp(prefix="retentio-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
