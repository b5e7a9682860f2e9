import pytest

from quire.llm.queries import ORACLES, QUERIES
from tests.llm.against_sql import difference
from tests.oracle import duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    assert difference(spark, duck(SF), name, SF) == ""


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
