import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lumenar.session import build_session

    session = build_session("4", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _no_cuts_left(request):
    """What a test has written to the shared folder goes with it."""
    yield
    if "spark" in request.fixturenames:
        from lumenar.session import clear_cuts

        clear_cuts(request.getfixturevalue("spark"))
