"""Physical-plan properties the design relies on (read from ``explain``)."""

import contextlib
import io


from tests.conftest import SF01
from wearline.operators import rul
from wearline.plans import drift as D
from wearline.plans.catalog import QUERIES
from wearline.sources.adapters import cycles, readings


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_filter_pushed_to_scan_and_columns_pruned(spark):
    ref, _ = D.sides(spark, SF01)
    p = plan(ref.select("tool_wear_min"))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p  # 2 of 6 columns


def test_per_unit_windows_share_one_exchange(spark):
    p = plan(QUERIES["rolling_features"](spark, SF01), "simple")
    assert p.count("Exchange hashpartitioning(unit_number") == 1


def test_last_row_per_unit_uses_group_limit(spark):
    p = plan(rul.last_cycle_rows(cycles(spark, SF01)), "simple")
    assert "WindowGroupLimit" in p


def test_recent_n_partial_limit_before_shuffle(spark):
    from wearline.operators.telemetry import recent_n
    from wearline.sources.adapters import telemetry
    p = plan(recent_n(telemetry(spark, SF01)), "simple")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_top_queue_is_take_ordered(spark):
    p = plan(QUERIES["top_queue"](spark, SF01), "simple")
    assert "TakeOrderedAndProject" in p


def test_selections_do_not_shuffle_the_table(spark, monkeypatch):
    """M1 is a scan with literals; queues exchange one row a task; no range shuffle is left in either."""
    from wearline.ml.split import stratified_split
    from wearline.operators import rank
    from wearline.operators.queue import queue_counts_by_selection

    def never(*_, **__):
        raise AssertionError("rows dealt to range buckets")

    monkeypatch.setattr(rank, "add_order_buckets", never)
    r = readings(spark, SF01)
    assert "Exchange" not in plan(stratified_split(r, n_buckets=8), "simple")
    q = plan(queue_counts_by_selection(r, [0.05, 0.1], n_buckets=8), "simple")
    assert q.count("Exchange") == q.count("Exchange SinglePartition") > 0 and "Sort" not in q and "Window" not in q
    D.drift.breakpoints(r, ["torque_nm", "tool_wear_min"], n_buckets=8)
    assert D.drift.bootstrap_sample(r, 50, n_buckets=8).count() == 50


def test_no_python_udf_on_batch_path(spark):
    for name in ("review_queue", "drift_report", "rolling_features", "model_rank", "oee", "calibration"):
        p = plan(QUERIES[name](spark, SF01), "simple")
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_ranking_metrics_single_collapse(spark):
    from wearline.operators.metrics import ranking_metrics
    p = plan(ranking_metrics(readings(spark, SF01), n_rows=10), "simple")
    assert p.count("HashAggregate(keys=[risk") >= 1 and "Window" in p


def scans(df) -> int:
    return plan(df, "simple").count("FileScan")


def test_few_scans_on_the_bucketed_path(spark, monkeypatch):
    from wearline.operators import rank
    monkeypatch.setattr(rank, "ROWS_PER_BUCKET", 1000)
    for name in ("drift_report", "wear_reset", "running_totals"):
        assert scans(QUERIES[name](spark, SF01)) <= 4, name
