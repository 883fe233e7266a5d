"""A query of each kind against its SQL, and the entry points. ``check.py`` runs all of them."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SOME = (
    "parse_currency",
    "score_all",
    "scd2_merge",
    "scd23_merge",
    "orphan_keys",
    "customer_risk_profile",
    "rescued_rows",
    "expired_versions",
    "region_quartile",
    "row_filtered_customers",
)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name) is None


def test_entry_points(spark):
    without_sql = set(queries()) - set(oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") for name in without_sql)
    assert set(oracle_sql()) <= set(queries())
    daily = entry(spark)
    assert "fraud_rate" in daily.columns and daily.take(1)
