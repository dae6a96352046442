import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberlog.session import local_session
from emberlog.workspace import Workspace

GOLDEN = os.path.join(os.path.dirname(os.path.abspath(__file__)), "golden")
DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.codegen.cache.maxEntries": "2000"})
    yield session
    session.stop()


@pytest.fixture
def ws(spark):
    space = Workspace(spark)
    yield space
    space.drop()


@pytest.fixture
def small_limits(monkeypatch):
    """Limits so low that small tables take the ways meant for large ones."""
    from emberlog.operators import indexing, lookup

    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(lookup, "HOT_ROWS", 20)
    monkeypatch.setattr(indexing, "SMALL_ROWS", 0)
    monkeypatch.setattr(indexing, "IN_MEMORY_ROWS", 0)
