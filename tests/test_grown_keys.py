"""Queries against their SQL on keys and times that the small tables do not have."""

from __future__ import annotations

import tempfile

import duckdb
import pytest

import __spark_entry__ as entry
from verify import normal


@pytest.fixture(scope="module")
def grown():
    """Users beyond 16 bits; each sends four events of one type, the last one 1.25 s after the first."""
    folder = tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i // 4 * 10000000 + CASE i % 4 WHEN 3 THEN 1250000 ELSE i % 4 * 400000 END) AS ts,
        65000 + i // 4 * 997 AS user_id, CASE WHEN i // 4 % 2 = 0 THEN 'click' ELSE 'error' END AS event_type,
        CAST(i % 500 AS DOUBLE) / 4 AS value, '{{"k": ' || (i % 100) || '}}' AS props FROM range(4000) t(i))
        TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", [
    "capture_flows", "log_file_scan", "parse_custom", "parse_line_quality", "parse_line_rejects", "parse_lines", "parse_mixed_layouts",
    "parse_mixed_rejects", "parse_native", "parse_native_rejects", "parse_quality", "parse_reason_counts", "parse_reject_sample",
    "port_scan_alerts"])
def test_query_equals_sql_on_large_keys(spark, grown, name):
    folder, con = grown
    got = entry.queries()[name](spark, folder).toPandas()
    assert len(got) and normal(got) == normal(con.sql(entry.oracle_sql()[name]).df())


def test_half_a_tenth_goes_up(spark, grown):
    found = entry.queries()["port_scan_alerts"](spark, grown[0]).where("description LIKE '% in 1.3s %'").count()
    assert found == 1000


def test_captures_tell_users_apart(spark, grown):
    assert entry.queries()["capture_flows"](spark, grown[0]).select("src_ip").distinct().count() == 1000
