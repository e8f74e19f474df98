import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from crivo.session import local_session

    s = local_session(4, "crivo-tests", memory="4g", spark__ui__showConsoleProgress="false")
    yield s
    s.stop()
