import pytest

from skeinwork.session import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
