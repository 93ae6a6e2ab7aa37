import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqweft.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "sliced"])
def mode(request, spark):
    """Runs a test with ordinary keys and again with every key of more than seven rows sliced."""
    if request.param == "sliced":
        spark.conf.set("spark.seqweft.hotRows", "7")
    yield request.param
    spark.conf.unset("spark.seqweft.hotRows")
