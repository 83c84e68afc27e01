from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from deckloom.session import session

    made = session("tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
