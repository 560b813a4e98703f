import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rootline.session import create_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return create_session("tests", "local[4]", 4, "4g")
