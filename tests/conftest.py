import pytest

from sweeplens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate column expressions on a single row."""
    def run(**columns):
        return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict(recursive=True)

    return run
