"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from compare import DATA, difference, duck

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_query(spark, con, name):
    assert difference(spark, con, name, SF) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
