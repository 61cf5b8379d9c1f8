"""Queries against DuckDB at the smallest scale: every family's operators, and of the panel algebra every sixth (all with BARLOOM_ALL=1)."""

import os

import pytest
from duck import compare, connect

from barloom import catalog

SF = "/root/testdata/sf0.001"
PANEL = [n for n in catalog.ORACLES if n.startswith(("op_", "feat_", "ind_", "pvm_"))]
REST = [n for n in catalog.ORACLES if n not in PANEL]
NAMES = list(catalog.ORACLES) if os.environ.get("BARLOOM_ALL") else REST + PANEL[::6]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)
