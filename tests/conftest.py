import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tarnlight.session import local_session

    session = local_session("tests", 4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
