import pytest

from palimpsest.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("4", 4, "tests")
    yield spark
    spark.stop()
