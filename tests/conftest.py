import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hushlake.plans.session import local_session  # noqa: E402
from hushlake.plans.storage import delete_work  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    delete_work(session)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
