"""Every registered query against its SQL, and the driver's entry points."""

import importlib.util
from pathlib import Path

import pytest

from quire.plans import registry
from tests.oracle import DATA, compare, duck

SF = str(DATA / "sf0.001")
registry.load()
# so few orders here that no customer loses all of them
EMPTY_HERE = {"drop_blank_errors"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    problem = compare(spark, con, name, SF)
    assert problem == ("both empty" if name in EMPTY_HERE else "")


def test_entry_points(spark):
    path = Path(__file__).parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_points", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
