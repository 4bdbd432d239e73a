import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ["TZ"] = "UTC"

import pytest  # noqa: E402

from timeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "6g", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
