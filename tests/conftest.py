import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from rivertrack.session import local_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, name="tests", partitions=4)
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """DataFrame -> sorted list of tuples."""

    def collect(df, *columns):
        out = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in out.collect()), key=repr)

    return collect
