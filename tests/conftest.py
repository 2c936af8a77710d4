import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def no_broadcast(monkeypatch):
    """Force the path for derived tables that are too large to broadcast."""
    from reviewloom.operators import bounds

    monkeypatch.setattr(bounds, "SETTLED_ROWS", 0)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
