import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from basketlens.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", app="basketlens-tests", shuffle_partitions=8)
    # Tests have no cluster checkpoint directory: use a fresh scratch one.
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="bl-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="bl-test-")
