import pytest

from lodestore.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", partitions=4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
