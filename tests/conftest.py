import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", spark__sql__files__maxPartitionBytes="4m")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
