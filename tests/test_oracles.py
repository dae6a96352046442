"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

from check import compare, duck
from conftest import DATA
from emberlog.contract.registry import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    verdict, rows, _, _ = compare(spark, con, key, SF)
    assert verdict == ("ok" if key in ORACLES else "rows-only") and rows > 0
