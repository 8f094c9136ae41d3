"""Registered queries against their DuckDB oracles at sf0.01 (a fast subset;
``python scripts/check_oracle.py`` runs every key)."""

import pytest

from scripts.check_oracle import compare, duck
from storecast.plans.catalog import ORACLE, QUERIES, load_all

from .conftest import SF_CHECK

load_all()

KEYS = ["counter_rollup", "events_quality", "period_keys", "oil_resample", "join_holidays",
        "feature_table", "renumber", "topk_batch", "search_context", "scenario_impact",
        "metric_format", "vector_upsert"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    assert compare(spark, con, key, QUERIES[key], ORACLE[key], SF_CHECK)


def test_every_key_has_a_job_and_smoke_runs(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() > 0
