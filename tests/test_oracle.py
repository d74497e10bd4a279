"""Bound queries against their check SQL on the smallest data folder.

A spread of one query in six runs by default; PROOFGRID_ORACLE=all runs all.
``check.py`` compares the full set at any scale.
"""

import os

import pytest

from check import compare, connect
from proofgrid.plans import load_all
from proofgrid.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
load_all()
NAMES = sorted(ORACLES) if os.environ.get("PROOFGRID_ORACLE") == "all" else sorted(ORACLES)[::6]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem, _ = compare(QUERIES[name](spark, FOLDER), ORACLES[name], con)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
