import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from voxelmetry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
