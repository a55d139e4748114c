import pytest

from urlrisk.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", shuffle_partitions=4, driver_memory="4g", app="urlrisk-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def urls(spark):
    """Builds a one-column URL table."""
    return lambda items: spark.createDataFrame([(u,) for u in items], "url string")
