import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from plexmat.session import local_session

    session = local_session(4, app="tests", partitions=4)
    yield session
    session.stop()
