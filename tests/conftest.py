import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
