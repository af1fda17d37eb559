from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowspark.schema import FLOW  # noqa: E402
from flowspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # Tiny inputs: compiling generated code costs more than it saves (verify.py runs compiled).
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.driver.memory": "4g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-check-", dir="/tmp")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")


@pytest.fixture
def flows(spark):
    def build(*groups):
        rows = [r for g in groups for r in g]
        full = [(i, dt.datetime.fromtimestamp(r[0] / 1e6, dt.timezone.utc), *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, FLOW)
    return build
