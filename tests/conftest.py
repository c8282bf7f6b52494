import pathlib
import os
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), os.path.join(str(ROOT), "tests")]


@pytest.fixture(scope="session")
def spark():
    from reelspark.session import local_session

    return local_session(8)
