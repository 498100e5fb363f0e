import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Spark's Python workers


@pytest.fixture(scope="session")
def spark():
    from tomeforge.session import local_session

    session = local_session(8, "tests", spark__checkpoint__dir=tempfile.mkdtemp(prefix="tomeforge-checkpoint-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
