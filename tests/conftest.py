import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from conceptmill.session import local_session

    # tiny plans: compiling them would take most of the time
    s = local_session(cpus=4, partitions=2, memory="4g", **{"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"})
    yield s
    s.stop()
