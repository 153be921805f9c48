"""Every registered query against its SQL, on the smallest tables."""

import importlib.util
from pathlib import Path

import oracle
import pytest

from saleslens import catalog

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    assert oracle.compare(catalog.QUERIES[name](spark, SMALL), con, catalog.SQL[name]) == []


def test_entry_points(spark):
    spec = importlib.util.spec_from_file_location("entry_module", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0
