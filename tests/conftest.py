import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sitemill.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(4, 4)
    yield session
    session.stop()
