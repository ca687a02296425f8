import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fairlead.session import session

    work = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{work}/shared",
        spark__sql__warehouse__dir=f"{work}/warehouse", spark__local__dir=str(work / "local"), spark__driver__extraJavaOptions=f"-Dderby.system.home={work}",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
