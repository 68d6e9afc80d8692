import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
