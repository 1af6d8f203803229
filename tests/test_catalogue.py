"""Every registered query against its SQL twin, over whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402

# Fits that take long; the checker in tools/ runs them too.
SLOW = {
    "grid_search", "cross_validate", "boost_train", "full_retrain", "performance_panel", "training_session", "retrain_labelled",
    "feature_importance",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    return check.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - SLOW))
def test_query_equals_its_sql(spark, db, sf_dir, name):
    assert check.compare(spark, db, sf_dir, name) is None


def test_entry_has_rows(spark, sf_dir):
    assert entry_points.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
