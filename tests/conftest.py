import pytest

from lectern.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
