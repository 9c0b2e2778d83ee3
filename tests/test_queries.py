"""Registered queries against their SQL at the smallest scale; PITPANEL_ALL=1 runs every one."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import oracle  # noqa: E402

from pitpanel.queries import load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
FAST = [
    "prior_mean_zero_filled", "ladder_collapse", "equal_count_bins", "exact_attempt_definitions", "team_event_measures",
    "asof_forward_by_group", "interval_join_modal_period", "preferred_then_fallback_key", "rival_cohort_block",
    "compare_lines_with_projections", "freeze_first_seen", "availability_grid", "reliability_curve", "stream_first_seen_freeze",
    "versioned_upsert_sink", "baselines_and_ship_gate",
]
NAMES = sorted(load_all()) if os.environ.get("PITPANEL_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message, _ = oracle.compare(spark, con, load_all()[name], SF)
    assert ok, message


def test_entry_point():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 100
