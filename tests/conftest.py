import os
import signal
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from landgraph.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def limit(request):
    """A test that hangs ends on its own and does not hide the rest."""

    def stop(*_):
        raise TimeoutError(f"{request.node.name} took over 15 minutes")

    signal.signal(signal.SIGALRM, stop)
    signal.alarm(900)
    yield
    signal.alarm(0)
