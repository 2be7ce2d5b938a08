import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    session.importable(s)
    yield s
    s.stop()
