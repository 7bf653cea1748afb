import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from pixsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """Bytes by name to a (path, content) table."""
    def make(blobs: dict):
        return spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "path STRING, content BINARY")

    return make
