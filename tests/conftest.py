from __future__ import annotations

import pytest

from .session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()
