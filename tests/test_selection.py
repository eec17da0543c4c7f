"""Selection by counting against Python's sort: any key type, both directions, ties, infinities, many positions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wearline.operators import rank
from wearline.operators import selection as S

COLUMNS = ["n", "x", "s", "l"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    x = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0, 1.0]
    x += [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1) * 10.0 ** rnd.randrange(-300, 300), 2.5, round(rnd.random(), 2)]) for _ in range(900)]
    rows = [(i, v, rnd.choice(["", "a", "ab", "abc\0", "abc", "y" * 40, f"prefix-long-{i}", f"é{i % 50}", None]),
             rnd.choice([None, i * 2**40 - 2**50, -2**63, 2**63 - 1, i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "n long, x double, s string, l long").repartition(5).cache()


def clean(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.encode() if isinstance(v, str) else v


def ordered(rows, key, tie, descending):
    """The library's contract by stable sorts: ties ascending, NULL (and NaN) last."""
    def by(name, reverse=False):
        known = [r for r in out if clean(r[name]) is not None]
        return sorted(known, key=lambda r: clean(r[name]), reverse=reverse) + [r for r in out if clean(r[name]) is None]

    out = rows
    out = by(tie)
    return by(key, descending)  # Python's reverse sort keeps equal rows in their order


@pytest.mark.parametrize("key, tie", [("x", "s"), ("l", "n"), ("s", "n")])
@pytest.mark.parametrize("descending", [False, True])
def test_rows_at_positions(table, key, tie, descending):
    want = ordered(table.collect(), key, tie, descending)
    rnd = random.Random(2)
    positions = [1, len(want), *rnd.sample(range(1, len(want)), 12)]
    for budget, parts in ((7, 16), (300, 256)):
        at = S.locate(table, S.order_keys(table, key, descending=descending, tie=tie), lambda sizes: [positions], budget=budget, parts=parts)
        assert all(i.count <= budget or at.settled(i) for i in at.intervals) and at.sizes == [len(want)]
        got = S.values_at(at, COLUMNS)
        for p in positions:
            assert [clean(got[0, p][c]) for c in (key, tie)] == [clean(want[p - 1][c]) for c in (key, tie)], (p, budget)


def test_cuts_split_rows(table):
    keys = S.order_keys(table, "x", descending=True, tie="s")
    cuts = S.cut(table, keys, lambda sizes: [[1, 100, 500, sizes[0]]], budget=20)
    for p in (1, 100, 500, cuts.sizes[0]):
        before, level = table.where(cuts.before(0, p)).count(), table.where(cuts.level(0, p)).count()
        assert before < p <= before + level


def test_slots_and_positions_out_of_range(table):
    groups, slot = S.group_slots(table.withColumn("g", F.when(F.col("n") % 3 > 0, F.col("n") % 3)), ["g"])
    assert len(groups) == 3
    d = table.withColumn("g", F.when(F.col("n") % 3 > 0, F.col("n") % 3))
    at = S.locate(d, S.order_keys(d, "n"), lambda sizes: [[0, 1, 2, 10**9], [], [sizes[2]]], slot=slot, n_slots=3, budget=2, parts=16)
    got = {k: r.n for k, r in S.values_at(at, ["n"]).items()}
    held = [sorted(r.n for r in d.collect() if (r.g is None and g[0] is None) or r.g == g[0]) for g in groups]
    assert got == {(0, 1): held[0][0], (0, 2): held[0][1], (2, len(held[2])): held[2][-1]}
    assert S.group_slots(d, ["n"]) is None
    none = S.locate(d.limit(0), S.order_keys(d, "n"), lambda sizes: [[1]], budget=2)
    assert none.sizes == [0] and S.values_at(none, ["n"]) == {}


def test_rounds_grow_with_the_logarithm(spark):
    d = spark.range(0, 200_000, 1, 8).select((F.xxhash64("id") % 2**59).alias("k"))
    at = S.locate(d, [F.col("k")], lambda sizes: [[sizes[0] // 3]], budget=50)
    assert at.rounds <= 2 and at.intervals[0].count <= 50


def test_quantiles_of_many_groups_are_ranked(spark):
    d = spark.range(600).select((F.col("id") % 100).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    few, many = (sorted(map(tuple, rank.exact_quantiles(d, "v", [0.0, 0.25, 0.9, 1.0], by=["g"], n_buckets=p).collect())) for p in (1, 8))
    assert few == many and len(many) == 100
