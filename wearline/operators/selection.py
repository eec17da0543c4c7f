"""Rows at given positions of an order, found by counting: no sort and no shuffle of the table.

``locate`` holds, for every wanted position, the interval of the order it lies in. One round is one aggregate: each
row's interval is looked up in literal arrays, the interval is cut into ``PARTS`` parts, and a partial-and-final count
with the least and greatest key of every part comes back (intervals x ``PARTS`` rows at most). The parts that hold a
position are the next round's intervals, tightened to the keys found in them. Rounds end when every interval holds at
most ``budget`` rows, or rows that are all alike. Only the rows of those intervals are ranked, or fetched.

An order is a list of key columns, compared one after another, each ``bigint`` or ``double`` and never NULL
(``order_keys`` makes them from a key and a tie of any common type, NULLs last). An interval whose rows all agree in one
key goes on with the next one, so a value that a third of all rows hold is cut by the keys after it.

Cuts of doubles are arithmetic on the key, which rounding keeps monotone: equal steps where the ends are of one size,
steps of the signed logarithm where they are not; 64-bit integers are cut by integer division.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts of an interval in one round; a round's counts, intervals x parts rows, come to the driver
PARTS, MOST_PARTS = 256, 1 << 17
#: bytes of a string that one integer key holds
CHUNK = 7
_LOW, _TOP = 1075.0, 2200.0  # log2 of the least positive double is -1074, of the largest 1024


def order_keys(df: DataFrame, key: str, *, descending: bool = False, tie: str | None = None) -> list[Column] | None:
    """Key columns of the library's ordering contract (key, then tie ascending; NaN counts as NULL, NULLs last), or
    None where a type has no such keys."""
    out = _keys(df, key, descending)
    more = _keys(df, tie, False) if tie is not None else []
    return None if out is None or more is None else out + more


def _keys(df: DataFrame, col: str, descending: bool) -> list[Column] | None:
    kind, c = df.schema[col].dataType.simpleString(), F.col(col)
    nothing = F.isnull(c)
    if kind in ("double", "float"):
        nothing = nothing | F.isnan(c)
        x = F.coalesce(F.when(~nothing, c.cast("double")), F.lit(0.0)) + F.lit(0.0)
        parts = [-x + F.lit(0.0) if descending else x]
    elif kind in ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp", "string"):
        if kind == "string":
            longest = df.agg(F.coalesce(F.max(F.octet_length(c)), F.lit(0))).first()[0]
            data, parts = c.cast("binary"), []
            for at in range(0, max(longest, 1), CHUNK):
                digits = F.rpad(F.hex(F.substring(data, at + 1, CHUNK)), 2 * CHUNK, "0")
                parts.append(F.conv(digits, 16, 10).cast("bigint"))
            parts.append(F.octet_length(c).cast("bigint"))  # a string and the same one with zero bytes after it
        else:
            parts = [F.unix_date(c).cast("bigint") if kind == "date" else F.unix_micros(c) if kind == "timestamp" else c.cast("bigint")]
        parts = [F.coalesce(p, F.lit(0).cast("bigint")) for p in parts]
        parts = [F.bitwise_not(p) for p in parts] if descending else parts
    else:
        return None
    return [nothing.cast("bigint"), *parts]


@dataclass
class Interval:
    """Rows of one slot that are neighbours in the order: ``before`` rows precede them in the slot."""

    slot: int
    before: int
    count: int
    positions: list[int]
    key: int = 0  # the key that cuts it
    lo: float | int = 0
    hi: float | int = 0


    @property
    def alike(self) -> bool:
        return self.lo == self.hi


@dataclass
class Located:
    """``rows`` are the input's with ``_wl_i``, the number of the interval they lie in, NULL where it holds no wanted
    position; ``sizes`` the rows of every slot."""

    rows: DataFrame
    intervals: list[Interval]
    sizes: list[int]
    keys: list[Column]
    rounds: int

    def settled(self, i: Interval) -> bool:
        """Whether all rows of the interval are equal in all keys."""
        return i.alike and i.key + 1 == len(self.keys)


def locate(df: DataFrame, keys: list[Column], wanted, *, slot: Column | None = None, n_slots: int = 1,
           budget: int, parts: int = PARTS) -> Located:
    """Intervals of at most ``budget`` rows (or of rows equal in all keys) around the wanted positions of every slot.

    ``slot`` numbers the orders 0 .. ``n_slots`` - 1 (rows with a NULL slot are in none); ``wanted(sizes)`` gives for each
    slot its positions, counted from 1."""
    kinds = [f.dataType.simpleString() for f in df.select(*keys).schema]
    rows = _apart(df, (F.lit(0) if slot is None else slot).cast("int"), "_wl_i")
    got = {r._wl_i: r for r in rows.groupBy("_wl_i").agg(F.count("*").alias("n"), F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).collect()}
    sizes = [got[s].n if s in got else 0 for s in range(n_slots)]
    todo, number = [], [None] * n_slots
    for s, ps in enumerate(wanted(sizes)):
        inside = sorted(p for p in set(ps) if 1 <= p <= sizes[s])
        if inside:
            number[s] = len(todo)
            todo.append(Interval(s, 0, sizes[s], inside, 0, got[s].lo, got[s].hi))
    at = Located(rows.withColumn("_wl_i", _lookup(number, F.col("_wl_i"))), todo, sizes, keys, 0)
    while True:
        _next_keys(at, budget)
        if all(_done(at, i, budget) for i in at.intervals):
            return at
        _cut(at, kinds, budget, parts)


def _apart(df: DataFrame, c: Column, name: str) -> DataFrame:
    """A column computed once: its expression is not copied into those that use it, nor moved below."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _done(at: Located, i: Interval, budget: int) -> bool:
    return i.count <= budget or at.settled(i)


def _next_keys(at: Located, budget: int) -> None:
    """Large intervals whose rows agree in their key go on with the next key (one aggregate for its ends)."""
    while True:
        stuck = [k for k, i in enumerate(at.intervals) if not _done(at, i, budget) and i.alike]
        if not stuck:
            return
        for k in stuck:
            at.intervals[k].key += 1
        used = sorted({at.intervals[k].key for k in stuck})
        held = at.rows.where(_lookup([k if k in set(stuck) else None for k in range(len(at.intervals))], F.col("_wl_i")).isNotNull())
        for r in held.groupBy("_wl_i").agg(*_ends(at.keys, used)).collect():
            i = at.intervals[r._wl_i]
            i.lo, i.hi = r[f"lo{i.key}"], r[f"hi{i.key}"]


def _ends(keys: list[Column], used: list[int]) -> list[Column]:
    return [f(keys[n]).alias(f"{name}{n}") for n in used for name, f in (("lo", F.min), ("hi", F.max))]


def _cut(at: Located, kinds: list[str], budget: int, parts: int) -> None:
    """One round: every interval not done is cut into parts, the parts without a wanted position are let go."""
    todo = at.intervals
    parts = max(16, min(parts, MOST_PARTS // len(todo)))
    here = F.col("_wl_i")
    code = here * F.lit(parts) + _part(at, kinds, budget, parts)
    rows = _apart(at.rows, code.cast("int"), "_wl_c")
    used = sorted({i.key for i in todo})
    got = rows.where("_wl_c is not null").groupBy("_wl_c").agg(F.count("*").alias("n"), *_ends(at.keys, used)).collect()  # intervals x parts at most
    fresh, number, before = [], [None] * (len(todo) * parts), [i.before for i in todo]
    for r in sorted(got, key=lambda r: r._wl_c):
        old = r._wl_c // parts
        start, before[old] = before[old], before[old] + r.n
        i = todo[old]
        inside = [p for p in i.positions if start < p <= start + r.n]
        if inside:
            number[r._wl_c] = len(fresh)
            fresh.append(Interval(i.slot, start, r.n, inside, i.key, r[f"lo{i.key}"], r[f"hi{i.key}"]))
    at.intervals, at.rounds = fresh, at.rounds + 1
    at.rows = rows.withColumn("_wl_i", _lookup(number, F.col("_wl_c"))).drop("_wl_c")


def _array(values: list, kind: str) -> Column:
    """A literal array of any length: one string, split and cast when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _lookup(values: list[int | None], at: Column) -> Column:
    """``values[at]``, NULL where either is."""
    return F.nullif(F.get(_array([-1 if v is None else v for v in values], "int"), at), F.lit(-1))


def _of_interval(at: Located, what, kind: str) -> Column:
    """A number of the row's interval."""
    values = [what(i) for i in at.intervals]
    return F.lit(values[0]).cast(kind) if len(set(values)) == 1 else F.get(_array([repr(v) for v in values], kind), F.col("_wl_i"))


def _part(at: Located, kinds: list[str], budget: int, parts: int) -> Column:
    """The part of its interval that a row is in, 0 to ``parts`` - 1 in the order of the key; 0 in intervals that are done."""
    out = F.lit(0)
    open_ = [i for i in at.intervals if not _done(at, i, budget)]
    for n in sorted({i.key for i in open_}):
        x = at.keys[n]

        def mine(what, other, n=n):
            return lambda i: what(i) if i.key == n and not _done(at, i, budget) else other

        def value(what, other, kind):
            return _of_interval(at, mine(what, other), kind)

        if kinds[n] == "double":
            straight = (x - value(lambda i: i.lo, 0.0, "double")) / value(lambda i: 1.0 if _curved(i) else i.hi - i.lo, 1.0, "double")
            size = F.when(F.abs(x) == math.inf, F.lit(_TOP)).when(x == 0, F.lit(0.0)).otherwise(F.log2(F.when(x != 0, F.abs(x)).otherwise(F.lit(1.0))) + F.lit(_LOW))
            level = F.signum(x) * size
            bent = (level - value(lambda i: _level(i.lo), 0.0, "double")) / value(lambda i: _level(i.hi) - _level(i.lo), 1.0, "double")
            share = F.when(value(_curved, False, "boolean"), bent).otherwise(straight)
            share = F.when(share > 0, F.least(share, F.lit(1.0))).otherwise(F.lit(0.0))  # also where it is no number: rows of other intervals
            place = F.floor(share * F.lit(float(parts))).cast("bigint")
        else:
            w = value(lambda i: _width(i, parts), 1, "bigint")
            place = F.call_function("div", x, w) - value(lambda i: _towards_zero(i.lo, _width(i, parts)), 0, "bigint")
        place = F.least(F.greatest(place, F.lit(0).cast("bigint")), F.lit(parts - 1).cast("bigint")).cast("int")
        out = F.when(value(lambda i: True, False, "boolean"), place).otherwise(out)
    return out


def _curved(i: Interval) -> bool:
    """Whether the ends differ in sign or size, so that equal steps would leave all rows in one."""
    return not (i.lo * i.hi > 0 and 0.25 <= i.lo / i.hi <= 4)


def _level(x: float) -> float:
    if not x:
        return 0.0
    return math.copysign(_TOP if math.isinf(x) else math.log2(abs(x)) + _LOW, x)


def _width(i: Interval, parts: int) -> int:
    return -(-(i.hi - i.lo + 1) // parts)


def _towards_zero(a: int, b: int) -> int:
    return -(-a // b) if a < 0 else a // b


def rows_at(at: Located, columns: list[str], position: str = "position") -> DataFrame:
    """The rows at the wanted positions, ``slot, position`` and their columns; of rows equal in all keys any.

    Only the intervals' rows are shuffled, each interval to one task (``budget`` rows at most); an interval of equal rows
    gives one of them for all its positions."""
    spark = at.rows.sparkSession
    settled = [at.settled(i) for i in at.intervals]
    want = spark.createDataFrame(  # the wanted positions: a parameter
        [(k, 1 if settled[k] else p - i.before, i.slot, p) for k, i in enumerate(at.intervals) for p in i.positions], f"_wl_i int, _wl_r int, slot int, {position} bigint")
    numbers = range(len(at.intervals))
    ranked = at.rows.where(_lookup([None if settled[k] else k for k in numbers] or [None], F.col("_wl_i")).isNotNull())
    ranked = ranked.select("_wl_i", F.row_number().over(Window.partitionBy("_wl_i").orderBy(*at.keys)).alias("_wl_r"), *columns)
    if any(settled):
        same = at.rows.where(_lookup([k if settled[k] else None for k in numbers], F.col("_wl_i")).isNotNull())
        same = same.groupBy("_wl_i").agg(F.first(F.struct(*columns)).alias("_wl_row")).select("_wl_i", F.lit(1).alias("_wl_r"), "_wl_row.*")
        ranked = ranked.unionByName(same)
    return ranked.join(F.broadcast(want), ["_wl_i", "_wl_r"]).select("slot", position, *columns)


@dataclass
class Cuts:
    """Where an order is cut: ``sizes`` the rows of every slot, ``values`` the keys of the row at each (slot, position)."""

    keys: list[Column]
    sizes: list[int]
    values: dict[tuple[int, int], list]

    def before(self, slot: int, position: int) -> Column:
        """Whether a row comes before the one at the position (rows equal to it in all keys do not)."""
        out = F.lit(False)
        for k, v in reversed(list(zip(self.keys, self.values[slot, position], strict=True))):
            out = (k < F.lit(v)) | ((k == F.lit(v)) & out)
        return out

    def level(self, slot: int, position: int) -> Column:
        """Whether a row equals the one at the position in all keys."""
        out = F.lit(True)
        for k, v in zip(self.keys, self.values[slot, position], strict=True):
            out = out & (k == F.lit(v))
        return out


def cut(df: DataFrame, keys: list[Column], wanted, *, slot: Column | None = None, n_slots: int = 1, budget: int, parts: int = PARTS) -> Cuts:
    """The keys at the wanted positions, as literals that later plans compare rows with."""
    names = [f"_wl_k{n}" for n in range(len(keys))]
    held = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], (F.lit(0) if slot is None else slot).alias("_wl_slot"))
    at = locate(held, [F.col(n) for n in names], wanted, slot=F.col("_wl_slot"), n_slots=n_slots, budget=budget, parts=parts)
    return Cuts(keys, at.sizes, {k: [r[n] for n in names] for k, r in values_at(at, names).items()})


def group_slots(df: DataFrame, by: list[str], most: int = 64) -> tuple[list, Column] | None:
    """The distinct groups (NULL is one) and the number of a row's group, or None where there are more than ``most``."""
    groups = df.select(*by).distinct().limit(most + 1).collect()
    if len(groups) > most:
        return None
    slot = F.lit(None).cast("int")
    for n, g in enumerate(groups):
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.lit(g[c]).cast(df.schema[c].dataType))
        slot = F.when(same, F.lit(n)).otherwise(slot)
    return groups, slot


def values_at(at: Located, columns: list[str]) -> dict[tuple[int, int], object]:
    """(slot, position) -> the row's columns; as many rows as there are positions come to the driver."""
    return {(r.slot, r.position): r for r in rows_at(at, columns).collect()}
