import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusframe.settings import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                       "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one text."""
    def value(text, fn):
        return spark.createDataFrame([(text,)], "t string").select(fn("t")).head()[0]
    return value
