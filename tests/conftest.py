import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"

from tallyloom.sources.tables import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session(4, 4)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
