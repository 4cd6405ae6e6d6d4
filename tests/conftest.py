import pytest

from ragspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, shuffle_partitions=4, app="tests")


def rows(df):
    """Rows as a sorted list of plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
