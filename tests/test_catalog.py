"""Registered queries against their SQL, on the smallest driver tables."""

import os

import pytest
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

# Queries that together touch every operator family; tests/compare.py runs all of them.
SAMPLE = [
    "flow_key",
    "flow_features",
    "flows_replay_exact",
    "captures",
    "interval_labels",
    "theta_select",
    "baseline_comparison",
    "class_report",
    "calibration_report",
    "throughput_table",
    "alert_evidence",
    "incidents",
    "verdict_cube",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    diff, _ = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert diff is None, diff


def test_every_check_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_captures_hold_hosts_of_any_number(spark, tmp_path):
    """User 75,005 is host 10.1.300.5, which has no four bytes of its own."""
    from flowlens.catalog import fixtures, queries

    events = spark.read.parquet(f"{SF}/events.parquet").limit(40)
    events.selectExpr("event_id", "ts", "user_id + 75000 user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    want = fixtures.packets(spark, str(tmp_path)).select(*queries.PACKET_FIELDS)
    got = queries.captures(spark, str(tmp_path)).select(*queries.PACKET_FIELDS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("src_ip LIKE '10.1.3__.%' OR dst_ip LIKE '10.1.3__.%'").count() == 40
