"""What large tables must not pay for twice: staged rows and splits, variants that are not scored to be counted."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF001
from wearline.ml import estimators, importance
from wearline.ml import workflows as W
from wearline.plans import closed_form
from wearline.sources.adapters import NUMERIC_FEATURES, readings
from wearline.streaming import state


def reads_events(df) -> bool:
    return any("events.parquet" in f for f in df.inputFiles())


def test_closed_form_splits_are_read_from_staged_rows(spark):
    train, test = closed_form._split(spark, SF001)
    assert not reads_events(train) and not reads_events(test)
    whole = readings(spark, SF001)
    assert train.count() + test.count() == whole.count() and train.columns == [*whole.columns, "is_test"]


def test_preprocessed_reads_no_events_again(spark):
    assert not reads_events(closed_form.q_preprocessed(spark, SF001))


def test_variants_are_counted_without_being_scored(spark, monkeypatch):
    holdout = readings(spark, SF001).where("product_id % 3 = 0")
    seen, ranking = [], importance.ranking_metrics

    def spy(df, *args, **kwargs):
        if kwargs.get("by"):
            seen.append((kwargs.get("n_rows"), df.count()))
        return ranking(df, *args, **kwargs)

    monkeypatch.setattr(importance, "ranking_metrics", spy)
    got = importance.permutation_importance(closed_form.risk_of, holdout, NUMERIC_FEATURES, repeats=2)
    assert got.count() == len(NUMERIC_FEATURES) and seen == [(seen[0][1], seen[0][1])]


def test_split_frames_keep_all_rows_and_columns(spark):
    whole = readings(spark, SF001)
    train, test = W.split_frames(whole)
    assert train.count() + test.count() == whole.count()
    assert train.drop("weight", "is_test").columns == whole.columns and test.where(F.col("is_test") != 1).count() == 0


def test_waiting_ticks_are_entries_of_many():
    ticks = np.zeros(2 * state.TICKS_AN_ENTRY + 1, state.TICK)
    ticks["tick"] = np.arange(len(ticks))
    entries = state._entries(ticks)
    assert [len(np.frombuffer(e, state.TICK)) for (e,) in entries] == [state.TICKS_AN_ENTRY] * 2 + [1]
    assert (np.concatenate([np.frombuffer(e, state.TICK) for (e,) in entries]) == ticks).all() and state._entries(ticks[:0]) == []


class Kept:
    """A state or a handle as a processor sees it, in memory."""

    def __init__(self):
        self.value, self.states, self.timers = None, {}, []

    def _state(self, name, *_):
        return self.states.setdefault(name, Kept())

    getValueState = _state

    def getListState(self, name, *_):
        self.states.setdefault(name, KeptList())
        return self.states[name]

    def getMapState(self, name, *_):
        self.states.setdefault(name, KeptMap())
        return self.states[name]

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers = sorted({*self.timers, at})

    def deleteTimer(self, at):
        self.timers.remove(at)


class KeptList(Kept):
    def get(self):
        return iter(self.value or [])

    def put(self, rows):
        self.value = list(rows)

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]


class KeptMap(Kept):
    def iterator(self):
        return iter((self.value or {}).items())

    def updateValue(self, key, value):
        self.value = {**(self.value or {}), key: value}

    def removeKey(self, key):
        self.value.pop(key)


class Mark:
    def __init__(self, millis):
        self.millis = millis

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.millis


def block(*ticks):
    rows = pd.DataFrame(ticks, columns=["machine", "micros", "tick", "event"])
    nobody, unnamed = rows.machine.isna(), rows.tick.isna()
    return rows.assign(nobody=nobody, unnamed=unnamed, machine=rows.machine.astype("Int64").fillna(0).astype("int64"), tick=rows.tick.astype("Int64").fillna(0).astype("int64"),
                       production=1, scrap=2, downtime=0.5, is_event=rows.event != "", event=rows.event)


def test_one_call_serves_all_machines_of_a_group():
    """Machines of a group keep apart: their lists, totals, counts and silences; one timer a group."""
    first = [block((1, 1000, 10, "x"), (2, 1000, 20, "y"), (None, 3000, None, "x")), block((1, 2000, 11, "z"), (1, 2000, None, ""), (2, 500, 21, "y"))]
    second = [block((2, 90_000_000, 22, "x"), (-3, 90_000_000, 30, ""))]
    for kind, after in ((state.Recent, lambda p: {(m, q): t for m, q, t in p.groupby(["machine_id", "batch_seq"], dropna=False).tick_id.apply(list).reset_index().astype(object).itertuples(index=False)}),
                        (state.Board, None)):
        handle, job = Kept(), kind(2, 50_000)
        job.init(handle)
        one, = job.handleInputRows((0,), iter(first), Mark(0))
        two, = job.handleInputRows((0,), iter(second), Mark(40_000))
        assert list(one.machine_id.fillna(-9).drop_duplicates()) == [1, 2, -9] and list(two.machine_id.drop_duplicates()) == [-3, 2] and handle.timers == [50_002]
        if after:
            got = {(None if m is pd.NA else m, q): [None if x is pd.NA else x for x in t] for (m, q), t in {**after(one), **after(two)}.items()}
            assert got == {(1, 1): [11, None], (2, 1): [20, 21], (None, 1): [None], (-3, 1): [30], (2, 2): [22, 20]}
            assert list(one.recency) == [1, 2, 1, 2, 1]
        else:
            assert one.production.tolist() == [3, 2, 1] and one.scrap.tolist() == [6, 4, 2] and one.downtime_s.tolist() == [1.5, 1.0, 0.5]
            assert [[(e["tick_id"], e["event"]) for e in r] for r in one.events] == [[(11, "z"), (10, "x")], [(20, "y"), (21, "y")], [(None, "x")]]
            assert list(one.kinds) == [{"x": 1, "z": 1}, {"y": 2}, {"x": 1}] and list(two.kinds) == [{}, {"x": 1, "y": 2}]
            assert two.production.tolist() == [1, 3] and two.batch_seq.tolist() == [1, 2]
        assert not list(job.handleExpiredTimer((0,), Mark(60_000), Mark(50_002)))  # 1 and the one without id are forgotten
        three, = job.handleInputRows((0,), iter([block((1, 91_000_000, 12, "z"), (2, 91_000_000, 23, ""))]), Mark(60_000))
        assert sorted(set(zip(three.machine_id.tolist(), three.batch_seq.tolist(), strict=True))) == [(1, 1), (2, 3)] and 140_000 in handle.timers
        assert not list(job.handleExpiredTimer((0,), Mark(999_999_999), Mark(140_000))) and not handle.states["heads"].exists()


def test_wear_of_a_group_keeps_machines_apart():
    """Ticks of several machines in one call: each adds to its own wear, one timer a group brings back what waits."""
    def ticks(*rows):
        return block(*[r[:3] + ("",) for r in rows]).assign(inc=[r[3] for r in rows], change=[r[4] for r in rows])

    handle, job = Kept(), state.Wear()
    job.init(handle)
    got = list(job.handleInputRows((0,), iter([ticks((1, 3000, 12, 2.0, False), (2, 1000, 20, 5.0, False), (1, 1000, 11, 1.0, False), (None, 2000, None, 7.0, False), (2, 9000, 21, 1.0, False))]), Mark(3)))
    assert [(None if m is pd.NA else m, w) for m, w in zip(got[0].machine_id, got[0].tool_wear_min, strict=True)] == [(1, 1.0), (1, 3.0), (2, 5.0), (None, 7.0)]
    assert handle.timers == [10] and not list(job.handleInputRows((0,), iter([ticks((1, 9500, 13, 4.0, True), (1, 9600, 14, 0.5, False))]), Mark(3)))
    late, = job.handleExpiredTimer((0,), Mark(20), Mark(10))
    assert list(zip(late.machine_id, late.tick_id, late.tool_wear_min, strict=True)) == [(1, 13, 0.0), (1, 14, 0.5), (2, 21, 6.0)]


def test_a_forest_works_on_every_core_and_keeps_its_nodes(spark, monkeypatch):
    train = spark.range(1000).coalesce(1)
    assert W.spread(train) is train  # few rows stay as they are
    monkeypatch.setattr(W, "PART_ROWS", 250)
    dealt = W.spread(train)
    want = min(4, spark.sparkContext.defaultParallelism)
    assert dealt.rdd.getNumPartitions() == want and sorted(r.id for r in dealt.collect()) == list(range(1000))
    forest = estimators.classifier("forest")
    assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() == estimators.FOREST_MB and forest.getNumTrees() == 300
