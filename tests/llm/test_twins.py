"""The SQL twins of this folder on the smallest tables."""

import pytest

import check
from lapsewise.llm.oracles import ORACLES
from lapsewise.llm.registry import QUERIES


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name, sf_dir):
    assert check.compare(spark, check.tables(sf_dir), name, sf_dir).startswith("ok")
