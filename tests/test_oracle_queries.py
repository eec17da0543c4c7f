"""Every registered query with an oracle equals DuckDB on the same parquet (sf0.001)."""

import pytest

from tests.conftest import SF001
from tests.oracle_check import compare, duck
from wearline.plans.catalog import ORACLE, QUERIES

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck(SF001)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF001, _con(), strict=True)  # doubles bit for bit
    assert r["status"] == "ok", r


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 3 and "assets_per_failure_caught" in df.columns


SMALL_BUCKET_QUERIES = ["review_queue", "queue_roi", "failure_mode_rank", "cost_by_mode", "strat_split",
                        "stratified_folds", "model_rank", "calibration", "drift_report", "bootstrap_drift",
                        "drift_by_window", "rolling_features", "running_totals", "wear_reset", "rul_eval",
                        "orders_review_queue", "lineitem_ranking_metrics"]


@pytest.mark.parametrize("name", SMALL_BUCKET_QUERIES)
def test_distributed_paths_match_oracle(spark, name, monkeypatch):
    """With a 100-row bucket budget every global order, quantile and hot group takes the
    bucketed path; results must still equal DuckDB bit for bit."""
    from wearline.operators import rank
    monkeypatch.setattr(rank, "ROWS_PER_BUCKET", 100)
    r = compare(spark, name, SF001, _con(), strict=True)
    assert r["status"] == "ok", r
