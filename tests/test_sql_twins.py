"""Every registered query beside its SQL twin on the smallest data set."""

import pytest

from caselens.workloads import load_all
from caselens.workloads.compare import compare, connect
from caselens.workloads.registry import ORACLES, QUERIES

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, sf, name):
    good, note = compare(spark, con, name, sf)
    assert good, note
