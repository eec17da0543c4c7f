"""Keyed state of the live jobs: value, list and map state in RocksDB, event-time timers, expiry.

The machines of a group are kept together, a few rows a machine packed many an entry, so that a batch costs a call a group and
not one a machine. A tick whose wear is wanted is appended to a list and read back when the watermark has passed it; of
readings and boards a machine that has been silent for ``idle`` is forgotten by its group's timer.

Defined results: ticks without ``ts`` cannot be ordered and are left out; a NULL ``tick_id`` stays NULL and comes after all ids
of its time; a NULL ``machine_id`` is a machine; NULL increments count 0. Ids keep all 64 bits: they reach the state
as (is it NULL, number), never as floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wearline.functions import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEAR_SCHEMA = "machine_id bigint, tick_id bigint, ts timestamp, tool_change boolean, tool_wear_min double"
RECENT_SCHEMA = "machine_id bigint, tick_id bigint, ts timestamp, recency int, batch_seq bigint"
BOARD_SCHEMA = ("machine_id bigint, batch_seq bigint, tick_id bigint, ts timestamp, first_ts timestamp, production bigint, scrap bigint, downtime_s double, "
                "events array<struct<tick_id:bigint,ts:timestamp,event:string>>, kinds map<string,bigint>")


def keep_state_on_disk(spark: SparkSession) -> None:
    """Processors need the RocksDB store: state larger than memory, changes written as a log."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def ticks(stream: DataFrame, *columns: str) -> DataFrame:
    """The machine, the tick's place and some columns, as the processors read them."""
    place = [F.unix_micros("ts").alias("micros"), F.col("tick_id").isNull().alias("unnamed"), F.coalesce("tick_id", F.lit(0).cast("bigint")).alias("tick")]
    return stream.where("ts is not null").select("machine_id", "ts", *place, *columns)


def _order(micros, unnamed, tick) -> np.ndarray:
    return np.lexsort((tick, unnamed, micros))


def _ids(unnamed, tick) -> pd.Series:
    """Ids with NULLs back in their place."""
    return pd.Series(tick, dtype="Int64").mask(pd.Series(unnamed, dtype=bool))


def _times(micros) -> np.ndarray:
    return np.asarray(micros, np.int64).astype("datetime64[us]")


def wear_after(wear: float, change: np.ndarray, inc: np.ndarray) -> np.ndarray:
    """Running wear over ordered ticks that starts from ``wear`` and is 0 at every change: one cumulative sum a stretch."""
    out = np.where(change, 0.0, inc)
    starts = np.concatenate([[0], np.flatnonzero(change), [len(out)]])
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            out[a:b] = np.cumsum(out[a:b])
    first = starts[1]
    out[:first] += wear
    return out


#: machines are kept in this many groups (by a hash of the id): a group, not a machine, costs a call a batch
GROUPS = 1024
_WHO = [("nobody", "?"), ("machine", "<i8")]
_AT = [("micros", "<i8"), ("unnamed", "?"), ("tick", "<i8")]
LAST = np.dtype([*_WHO, *_AT])
EVENT = np.dtype([*_WHO, *_AT, ("kind", "<i8")])
COUNT = np.dtype([*_WHO, ("n", "<i8")])
#: one row a machine: its newest tick, how often it was given out, whether this batch has ticks of it
HEAD = np.dtype([*_WHO, *_AT, ("seq", "<i8"), ("seen", "?")])
TOTALS = np.dtype([*HEAD.descr, ("first", "<i8"), ("production", "<i8"), ("scrap", "<i8"), ("downtime", "<f8")])
_JOINED = {"seq": np.maximum, "seen": np.logical_or, "first": np.minimum, "production": np.add, "scrap": np.add, "downtime": np.add, "n": np.add}


def _grouped(s: DataFrame):
    """Ticks by group of machines; a machine's id is (is it NULL, number), as the tick's is."""
    who = {"nobody": F.col("machine_id").isNull(), "machine": F.coalesce("machine_id", F.lit(0).cast("bigint"))}
    return s.withColumns({"part": F.pmod(F.xxhash64("machine_id"), F.lit(GROUPS).cast("bigint")), **who}).drop("machine_id").groupBy("part")


def _filled(shape: np.dtype, pdf: pd.DataFrame, **more) -> np.ndarray:
    out = np.zeros(len(pdf), shape)
    for name in shape.names:
        if name in more or name in pdf:
            out[name] = more.get(name, pdf.get(name))
    return out


def _by_machine(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by machine, and where each machine's begin; of a machine the newest first, of one time the greatest id first, a NULL
    id last, as ``ORDER BY ts DESC, tick_id DESC NULLS LAST``."""
    place = (~rows["tick"], rows["unnamed"], ~rows["micros"]) if "tick" in rows.dtype.names else ()
    rows = rows[np.lexsort((*place, rows["machine"], rows["nobody"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["machine"][1:] != rows["machine"][:-1]) | (rows["nobody"][1:] != rows["nobody"][:-1])
    return rows, np.flatnonzero(new)


def _top(rows: np.ndarray, n: int) -> np.ndarray:
    """The newest ``n`` rows of each machine."""
    rows, at = _by_machine(rows)
    return rows[_places(at, len(rows)) < n]


def _places(at: np.ndarray, n: int) -> np.ndarray:
    """Each row's place among its machine's rows."""
    return np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))


def _joined(rows: np.ndarray) -> np.ndarray:
    """One row a machine: its newest tick, its figures joined."""
    rows, at = _by_machine(rows)
    out = rows[at]
    for name, how in _JOINED.items():
        if name in rows.dtype.names:
            out[name] = how.reduceat(rows[name], at)
    return out


def _index(heads: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The place of each row's machine in ``heads``, which come from ``_joined``."""
    named = int((~heads["nobody"]).sum())
    return np.where(rows["nobody"], named, np.searchsorted(heads["machine"][:named], rows["machine"]))


def _held(state, kind: np.dtype) -> np.ndarray:
    """The rows of a list state's entries, or of a value."""
    entries = list(state.get()) if hasattr(state, "appendList") else ([state.get()] if state.exists() else [])
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(e[0], kind) for e in entries)])


class _Expiring(StatefulProcessor):
    """Groups of machines; forgets a machine whose last tick lies ``idle_ms`` behind the watermark, before ticks of the batch are taken."""

    idle_ms: int
    kind: np.dtype

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "machines binary")

    def _alive(self, timerValues) -> tuple[np.ndarray, np.ndarray]:
        """The group's machines, and which of them are not overdue."""
        heads = _held(self.heads, self.kind)
        return heads, heads["micros"] // 1000 + self.idle_ms > timerValues.getCurrentWatermarkInMs()

    def _keep(self, heads: np.ndarray, fired: int | None = None) -> None:
        """Keep the machines, with one timer a group: at the end of the first silence."""
        at = int(heads["micros"].min()) // 1000 + self.idle_ms if len(heads) else None
        for old in list(self.handle.listTimers()):
            if old not in (at, fired):
                self.handle.deleteTimer(old)
        if at is None:
            self.heads.clear()
            return
        heads = heads.copy()
        heads["seen"] = False
        self.heads.update((heads.tobytes(),))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


#: a tick that waits, in the order in which ticks are given out; ticks of one list entry at most
TICK = np.dtype([*_WHO, ("micros", "<i8"), ("unnamed", "?"), ("tick", "<i8"), ("change", "?"), ("inc", "<f8")])
TICKS_AN_ENTRY = 10_000


def _entries(ticks: np.ndarray) -> list[tuple[bytes]]:
    """Ticks as list entries of bounded size."""
    return [(ticks[at:at + TICKS_AN_ENTRY].tobytes(),) for at in range(0, len(ticks), TICKS_AN_ENTRY)]


#: a machine's wear so far
WORN = np.dtype([*_WHO, ("wear", "<f8")])


class Wear(StatefulProcessor):
    """R3. Value state: the wear so far of a group's machines. List state: their ticks that the watermark has not passed, many an entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wear = handle.getValueState("wear", "machines binary")
        self.waiting = handle.getListState("waiting", "ticks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList(_entries(_filled(TICK, pdf)))
        yield from self._settle(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues)

    def _settle(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Give out, in order, the ticks that the watermark has passed, and come back for the first that has to wait."""
        held = _held(self.waiting, TICK)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        passed, rest = held[held["micros"] <= mark], held[held["micros"] > mark]
        if len(passed):
            passed = passed[np.lexsort([passed[name] for name in reversed(TICK.names)])]  # by machine, then in order
            worn = _held(self.wear, WORN)
            last, at = _by_machine(passed[["nobody", "machine"]])
            before = {(n, m): wear for n, m, wear in worn.tolist()}
            now, ends = last[at].tolist(), [*at[1:].tolist(), len(passed)]
            wear = np.concatenate([wear_after(before.get(who, 0.0), passed["change"][a:b], passed["inc"][a:b]) for who, a, b in zip(now, at.tolist(), ends, strict=True)])
            before.update((who, float(wear[b - 1])) for who, b in zip(now, ends, strict=True))
            self.wear.update((np.array([(*who, w) for who, w in before.items()], WORN).tobytes(),))
            self.waiting.put(_entries(rest)) if len(rest) else self.waiting.clear()
            yield pd.DataFrame({"machine_id": _ids(passed["nobody"], passed["machine"]), "tick_id": _ids(passed["unnamed"], passed["tick"]), "ts": _times(passed["micros"]),
                                "tool_change": passed["change"], "tool_wear_min": wear})
        if len(rest):
            first = int(rest["micros"].min())
            self.handle.registerTimer(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def wear_tracking(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Wear per machine that accumulates and resets on a tool change; equals batch W9 on all ticks that are not later
    than the watermark. A tick is given out when the watermark has passed it; a machine's state is its wear and the
    ticks of one watermark delay."""
    keep_state_on_disk(stream.sparkSession)
    inc = F.coalesce(F.when(~F.isnan("wear_inc"), F.col("wear_inc")), F.lit(0.0)).alias("inc")
    s = ticks(stream.withWatermark("ts", watermark), F.coalesce("tool_change", F.lit(False)).alias("change"), inc)
    return _grouped(s).transformWithStateInPandas(Wear(), WEAR_SCHEMA, "append", "eventTime")


class Recent(_Expiring):
    """R4, readings. List state: the last ``n`` ticks of a group's machines, many an entry. Value state: the machines and how often
    each was given out."""

    kind = HEAD

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", "ticks binary")

    def _load(self, timerValues) -> tuple[np.ndarray, np.ndarray]:
        heads, alive = self._alive(timerValues)
        last = _held(self.last, LAST)
        return heads[alive], last[alive[_index(heads, last)]] if len(heads) else last

    def _save(self, heads: np.ndarray, last: np.ndarray, fired: int | None = None) -> None:
        self.last.put(_entries(last)) if len(last) else self.last.clear()
        self._keep(heads, fired)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heads, last = self._load(timerValues)
        for pdf in rows:  # never more than n rows a machine and one block at once
            heads = _joined(np.concatenate([heads, _filled(HEAD, pdf, seen=True)]))
            last = _top(np.concatenate([last, _filled(LAST, pdf)]), self.n)
        heads["seq"] += heads["seen"]
        self._save(heads, last)
        of = _index(heads, last)
        place = _places(np.flatnonzero(np.diff(of, prepend=-1)), len(of)) + 1
        out = heads["seen"][of]
        last, of, place = last[out], of[out], place[out]
        yield pd.DataFrame({"machine_id": _ids(last["nobody"], last["machine"]), "tick_id": _ids(last["unnamed"], last["tick"]), "ts": _times(last["micros"]),
                            "recency": place.astype(np.int32), "batch_seq": heads["seq"][of]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._save(*self._load(timerValues), expiredTimerInfo.getExpiryTimeInMs())
        yield from ()


def _millis(spark: SparkSession, idle: str) -> int:
    return int(spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}")) / 1000).first()[0])


def recent_readings(stream: DataFrame, n: int = C.RECENT_READINGS, watermark: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """After each micro-batch the current last ``n`` ticks of every machine seen in it (update mode; ``batch_seq``
    orders what is given out). A machine silent for ``idle`` is forgotten."""
    keep_state_on_disk(stream.sparkSession)
    s = ticks(stream.withWatermark("ts", watermark))
    return _grouped(s).transformWithStateInPandas(Recent(n, _millis(stream.sparkSession, idle)), RECENT_SCHEMA, "update", "eventTime")


class Board(_Expiring):
    """R4, the rest of the live board. Value state: totals and latest tick of a group's machines. List state: their last ``n`` events,
    many an entry. Map state: a kind's number, by which events name it, and its events by machine."""

    kind = TOTALS

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.events = handle.getListState("events", "events binary")
        self.kinds = handle.getMapState("kinds", "kind string", "number bigint, counts binary")

    def _load(self, timerValues) -> tuple[np.ndarray, np.ndarray, dict]:
        """Totals, events, and of each kind: its number, its counts and whether they have changed."""
        heads, alive = self._alive(timerValues)
        events, kinds = _held(self.events, EVENT), {}
        for (kind,), (number, packed) in list(self.kinds.iterator()):
            counts = np.frombuffer(packed, COUNT)
            kept = counts[alive[_index(heads, counts)]]
            kinds[kind] = (number, kept, len(kept) < len(counts))
        return heads[alive], events[alive[_index(heads, events)]] if len(events) else events, kinds

    def _save(self, heads: np.ndarray, events: np.ndarray, kinds: dict, fired: int | None = None) -> None:
        self.events.put(_entries(events)) if len(events) else self.events.clear()
        for kind, (number, counts, changed) in kinds.items():
            if changed and len(counts):
                self.kinds.updateValue((kind,), (number, counts.tobytes()))
            elif changed:
                self.kinds.removeKey((kind,))
        self._keep(heads, fired)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heads, events, kinds = self._load(timerValues)
        for pdf in rows:
            heads = _joined(np.concatenate([heads, _filled(TOTALS, pdf, first=pdf.micros, seen=True)]))
            of = pdf[pdf.is_event]
            if not len(of):
                continue
            numbers = np.zeros(len(of), np.int64)
            for kind in of.event.unique():
                number, counts, _ = kinds.get(kind) or (max((k[0] for k in kinds.values()), default=-1) + 1, np.zeros(0, COUNT), True)
                mine = (of.event == kind).to_numpy()
                numbers[mine] = number
                kinds[kind] = (number, _joined(np.concatenate([counts, _filled(COUNT, of[mine], n=1)])), True)
            events = _top(np.concatenate([events, _filled(EVENT, of, kind=numbers)]), self.n)
        heads["seq"] += heads["seen"]
        self._save(heads, events, kinds)
        listed, counted = [[] for _ in heads], [{} for _ in heads]
        named = {number: kind for kind, (number, _, _) in kinds.items()}
        for i, micros, unnamed, tick, number in zip(_index(heads, events).tolist(), *(events[c].tolist() for c in ("micros", "unnamed", "tick", "kind")), strict=True):
            if heads["seen"][i]:
                listed[i].append({"tick_id": None if unnamed else tick, "ts": pd.Timestamp(micros, unit="us"), "event": named[number]})
        for kind, (_, counts, _) in kinds.items():
            for i, n in zip(_index(heads, counts).tolist(), counts["n"].tolist(), strict=True):
                counted[i][kind] = n
        out, seen = heads[heads["seen"]], np.flatnonzero(heads["seen"]).tolist()
        yield pd.DataFrame({"machine_id": _ids(out["nobody"], out["machine"]), "batch_seq": out["seq"], "tick_id": _ids(out["unnamed"], out["tick"]), "ts": _times(out["micros"]),
                            "first_ts": _times(out["first"]), "production": out["production"], "scrap": out["scrap"], "downtime_s": out["downtime"],
                            "events": [listed[i] for i in seen], "kinds": [counted[i] for i in seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._save(*self._load(timerValues), expiredTimerInfo.getExpiryTimeInMs())
        yield from ()


def live_board(stream: DataFrame, n: int = C.RECENT_EVENTS, watermark: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """Per micro-batch and machine seen in it the latest reading, production totals since its first tick, the last ``n`` events
    (scrap, tool change), newest first, and events by kind. ``production_stats`` makes the OEE figures of the totals."""
    keep_state_on_disk(stream.sparkSession)
    number = [F.coalesce(F.col(c), F.lit(0)).cast(t).alias(a) for c, t, a in (("production_inc", "bigint", "production"), ("scrap_inc", "bigint", "scrap"))]
    downtime = F.coalesce(F.when(~F.isnan("downtime_s"), F.col("downtime_s")), F.lit(0.0)).alias("downtime")
    event = F.coalesce(F.col("tool_change") | (F.col("scrap_inc") > 0), F.lit(False)).alias("is_event")
    s = ticks(stream.withWatermark("ts", watermark), *number, downtime, event, F.coalesce("machine_type", F.lit("")).alias("event"))
    return _grouped(s).transformWithStateInPandas(Board(n, _millis(stream.sparkSession, idle)), BOARD_SCHEMA, "update", "eventTime")


def production_stats(board: DataFrame) -> DataFrame:
    """OEE of a board's totals over the time from a machine's first tick to its latest."""
    from wearline.operators.telemetry import oee_columns

    elapsed = (F.unix_micros("ts") - F.unix_micros("first_ts")) / 1e6
    return board.select("machine_id", "batch_seq", "production", "scrap", "downtime_s",
                        *[v.alias(k) for k, v in oee_columns("production", "scrap", "downtime_s", elapsed).items()])
