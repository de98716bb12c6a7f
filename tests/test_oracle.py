"""Registered queries against DuckDB at the smallest scale; GAUGELINE_ALL_QUERIES=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from gaugeline import catalog

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["condition_leaderboard", "b14_parser_coverage", "d2_majority_vote", "e3_run_numbers", "f5_ledger",
          "g10_cluster_findings", "i3_cluster_input_hash", "j3_oos_mentions", "k10_verify_runs", "l2_live_counters"]
NAMES = list(entry.queries()) if os.environ.get("GAUGELINE_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, connection, name):
    problem, _, _ = compare(spark, connection, name, FOLDER)
    assert problem is None


def test_every_query_has_an_oracle():
    """Queries of the catalog; others may be beyond SQL."""
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
