"""Registered queries against their SQL on the smallest tables; ``verify.py`` covers all of them."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowspark.catalog.oracles import ORACLES
from flowspark.catalog.queries import QUERIES
from verify import normal

FOLDER = "/root/testdata/sf0.001"
SOME = ("flows_from_lineitem", "port_scan_incidents_tied", "brute_force_incidents", "dns_incidents", "beacon_intervals",
        "off_hours_sources", "threat_feed_groups", "ml_features", "exact_quantiles", "merge_duplicates", "traffic_summary",
        "replay_totals", "parse_native", "parse_line_rejects", "capture_flows")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"forest_scores", "detect_all"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert normal(got) == normal(tables.sql(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
