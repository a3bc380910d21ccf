import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from silkloom.session import local, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local(4, "4g")
    ship(session)
    yield session
    session.stop()
