import pytest

from tideloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g", **{"spark.sql.ansi.enabled": "true"})
    yield session
    session.stop()
