import pytest

from quire.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "quire-tests", memory="6g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression."""
    def value(expr):
        return spark.range(1).select(expr.alias("v")).first()["v"]

    return value
