from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tracewell.session import session

    where = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(where / "warehouse"), "spark.checkpoint.dir": f"file://{where}/shared", "spark.driver.memory": "4g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
