"""Named queries against their SQL counterparts on the smallest data set."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from wayside.plans.catalog import QUERIES
from wayside.plans.oracles import ORACLES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: One or more per area; ORACLE_ALL=1 runs every query.
SAMPLE = (
    "gtfs_time_seconds local_times service_day_flags stop_skeleton_zero_keys stop_merge_forced stop_updates_keep_latest"
    " trip_ping_merge added_trips voms_peak_by_day service_day_rollup otp_by_route_month routes_consistently_late"
    " voms_month_fiscal_peaks flatten_trip_updates gap_work_list feed_version_register table_verdicts dim_trip"
    " outage_windows stream_ping_summary"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names_match():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
