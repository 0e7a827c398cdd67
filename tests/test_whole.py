"""Queries whose tables at sf0.001 are too small for their cases, against their SQL over larger ones."""

import os

import duckdb
import pytest
from test_oracles import TABLES, rows

from tessera.plans import ORACLES, QUERIES

DIR = os.environ.get("TEST_WHOLE_DIR", "/root/testdata/sf0.01")
NAMES = ["G12_cycles", "G17_strong_components", "G18_overlay_cycles", "K04_path_alias", "K08_inventory_sweep", "T04_maintained_observations", "T05_incomplete_scan_keeps", "J05_edge_endpoints", "J19_point_in_interval", "J20_variant_choice", "S03_code_scan"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = rows(QUERIES[name](spark, DIR).toPandas())
    want = rows(c.sql(ORACLES[name]).df())
    assert got == want and got
