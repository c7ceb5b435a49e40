import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import build_session
    s = build_session("local[4]", 4, app_name="ledgerlens-tests", driver_memory="6g",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ll-test-ckpt-")})
    yield s
    from ledgerlens.session import drop_scratch
    drop_scratch(s)
    s.stop()


SMALL = "/root/testdata/sf0.001"
