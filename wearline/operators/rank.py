"""Exact order statistics without a single-task sort: one ordering contract for every size.

The order is (key, tie): NaN keys count as NULL, NULLs come last in both directions, -0.0 equals
0.0, and keys and ties may be of any orderable type (strings included). Small inputs (at most
``ROWS_PER_BUCKET`` rows, a proven bound) take a plain window; larger ones are cut into range
buckets, with the same result to the last bit:

1. ``repartitionByRange`` on (groups, key, tie) deals the rows to ordered buckets. A hot group or a
   value that a third of all rows hold spans many buckets, because groups and ties are part of
   the range key. The dealt rows are written to the shared folder once, so that every later use
   reads the same buckets (range bounds come from a sample and may change when recomputed);
2. exact per-bucket counts and sums (a P-row table) give each bucket its offset;
3. ``row_number`` / running sums inside each bucket plus the offset.

Sums of doubles run over decimals (12 places), so they do not depend on the buckets; values that decimals do not
hold (beyond 1e24, between 0 and 1e-3, infinities) are summed as doubles beside them and added, in running and in
segmented sums alike.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wearline.session import stage

BUCKET = "_wl_bucket"
KEY = "_wl_key"
ROWS_PER_BUCKET = 2_000_000  # rows one task may sort or hold
MAX_BUCKETS = 65536  # offsets table <= 64k rows (~1 MB broadcast)
EXACT = "decimal(38,12)"


def _default_buckets(df: DataFrame, n_rows: int | None, rows_per_bucket: int) -> int:
    """Buckets from data size: one bucket while all rows fit one task's budget.

    Larger inputs get ceil(N / rows_per_bucket) buckets, at least the cluster's parallelism.
    """
    if n_rows is None:
        n_rows = df.count()
    if n_rows <= rows_per_bucket:
        return 1
    par = df.sparkSession.sparkContext.defaultParallelism
    return int(min(MAX_BUCKETS, max(par, math.ceil(n_rows / max(rows_per_bucket, 1)))))


def quantile_grid(n: int, percent: bool = False) -> list[float]:
    """The fractions 0, 1/n, ..., 1 exactly as ``numpy.linspace(0, 1, n + 1)`` makes them
    (i * (1/n), e.g. 0.7000000000000001): interpolated quantiles at these fractions can
    differ from those at i / n in the last bits, which creates or merges breakpoints on
    tied data. ``percent=True`` reproduces ``numpy.percentile(x, grid * 100)``."""
    grid = np.linspace(0.0, 1.0, n + 1)
    if percent:
        grid = (grid * 100.0) / 100.0
    return [float(v) for v in grid]


def cleaned(df: DataFrame, col: str) -> Column:
    """The ordering key: NaN as NULL and -0.0 as 0.0 for floating point, anything else as it is."""
    if df.schema[col].dataType.simpleString() in ("double", "float"):
        return F.when(~F.isnan(col), F.col(col) + F.lit(0.0)).cast(df.schema[col].dataType)
    return F.col(col)


def _order(descending: bool, tie: str | None) -> list[Column]:
    cols = [F.col(KEY).desc_nulls_last() if descending else F.col(KEY).asc_nulls_last()]
    if tie is not None:
        cols.append(F.col(tie).asc_nulls_last())
    return cols


def add_order_buckets(df: DataFrame, key: str, *, descending: bool = False, tie: str | None = None,
                      by: list[str] | tuple = (), n_buckets: int | None = None, n_rows: int | None = None,
                      rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``_wl_key`` (the cleaned key) and ``_wl_bucket`` (bigint): within each ``by`` group, bucket
    order equals the order of ``(key, tie)``. One range shuffle, staged; with one bucket nothing moves."""
    p = n_buckets or _default_buckets(df, n_rows, rows_per_bucket or ROWS_PER_BUCKET)
    work = df.withColumn(KEY, cleaned(df, key))
    if p <= 1:
        return work.withColumn(BUCKET, F.lit(0).cast("bigint"))
    ranged = work.repartitionByRange(p, *[F.col(c) for c in by], *_order(descending, tie))
    return stage(ranged.withColumn(BUCKET, F.spark_partition_id().cast("bigint")), "ranges")


def _offsets(bucketed: DataFrame, by: list[str], sums: dict[str, Column], zero: bool = True) -> DataFrame:
    """Exact per-bucket totals turned into exclusive prefix offsets (small table): 0, or NULL, where nothing precedes."""
    per = bucketed.groupBy(*by, BUCKET).agg(*[v.alias(k) for k, v in sums.items()])
    w = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = {k: F.sum(k).over(w) for k in sums}
    return per.select(*by, BUCKET, *[(F.coalesce(c, F.lit(0)) if zero else c).alias(f"_wl_off_{k}") for k, c in before.items()])


def _join_offsets(bucketed: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    # With no grouping the offset table has at most MAX_BUCKETS rows: a proven bound,
    # so it is broadcast. With grouping columns the size depends on the number of
    # groups; AQE decides from runtime statistics. Groups may be NULL.
    off = offsets.select(*[F.col(c).alias(f"_wl_j_{c}") for c in by], F.col(BUCKET).alias("_wl_j"),
                         *[c for c in offsets.columns if c.startswith("_wl_off_")])
    on = F.col(BUCKET) == F.col("_wl_j")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_wl_j_{c}"))
    return bucketed.join(F.broadcast(off) if not by else off, on, "inner").drop("_wl_j", *[f"_wl_j_{c}" for c in by])


def join_groups(left: DataFrame, right: DataFrame, by: list[str], on: list[str] | tuple = (), how: str = "inner") -> DataFrame:
    """Join on the groups ``by``, where NULL is a group, and on the plain columns ``on``."""
    right = right.select(*[F.col(c).alias(f"_wl_j_{c}") if c in (*by, *on) else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in (*by, *on):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_wl_j_{c}"))
    return left.join(right, cond, how).drop(*[f"_wl_j_{c}" for c in (*by, *on)])


def global_row_number(df: DataFrame, key: str, *, descending: bool = False, tie: str | None = None,
                      by: list[str] | tuple = (), out: str = "rn", n_buckets: int | None = None,
                      n_rows: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by by order by key, tie)`` for groups of any size."""
    by = list(by)
    b = add_order_buckets(df, key, descending=descending, tie=tie, by=by, n_buckets=n_buckets, n_rows=n_rows)
    if _one_bucket(b):
        w = Window.partitionBy(*by).orderBy(*_order(descending, tie))
        return b.withColumn(out, F.row_number().over(w).cast("bigint")).drop(BUCKET, KEY)
    off = _offsets(b, by, {"n": F.count(F.lit(1))})
    w = Window.partitionBy(*by, BUCKET).orderBy(*_order(descending, tie))
    return (_join_offsets(b, off, by)
            .withColumn(out, (F.row_number().over(w) + F.col("_wl_off_n")).cast("bigint"))
            .drop(BUCKET, KEY, "_wl_off_n"))


def _one_bucket(bucketed: DataFrame) -> bool:
    """Whether the bucket column is the literal of an input that fits one bucket."""
    return not bucketed.schema[BUCKET].nullable


#: sizes of doubles that decimals of 26 + 12 places hold well
LEAST_EXACT, MOST_EXACT = 1e-3, 1e24


def _exact_part(x: Column) -> Column:
    """The value as a decimal, where its size allows it; NULL otherwise (and for NaN and NULL)."""
    return F.when((x == 0) | F.abs(x).between(LEAST_EXACT, MOST_EXACT), x).try_cast(EXACT)


def _other_part(x: Column) -> Column:
    """Very large, very small and infinite values, which are summed as doubles; NULL for all others."""
    return F.when(~F.isnan(x) & (x != 0) & ~F.abs(x).between(LEAST_EXACT, MOST_EXACT), x)


def _summands(df: DataFrame, col: str) -> list[Column]:
    """What is summed: a double as its exact part and the rest."""
    if df.schema[col].dataType.simpleString() in ("double", "float"):
        x = F.col(col).cast("double")
        return [_exact_part(x), _other_part(x)]
    return [F.col(col)]


def _total(parts: list[Column]) -> Column:
    """A sum put together from those of its parts: NULL where nothing has been summed."""
    if len(parts) == 1:
        return parts[0]
    exact, rest = parts[0].cast("double"), parts[1]
    return F.when(exact.isNull(), rest).when(rest.isNull(), exact).otherwise(exact + rest)


def running_sums(df: DataFrame, key: str, sums: dict[str, str], *, descending: bool = False,
                 tie: str | None = None, by: list[str] | tuple = (), n_buckets: int | None = None,
                 n_rows: int | None = None) -> DataFrame:
    """Exact running sums (rows frame, inclusive) in ``(key, tie)`` order.

    ``sums`` maps output column -> input column. NaN counts as NULL; a sum is NULL before its first value.
    """
    by = list(by)
    b = add_order_buckets(df, key, descending=descending, tie=tie, by=by, n_buckets=n_buckets, n_rows=n_rows)
    what = {o: _summands(df, src) for o, src in sums.items()}
    frame = (Window.unboundedPreceding, Window.currentRow)
    if _one_bucket(b):
        w = Window.partitionBy(*by).orderBy(*_order(descending, tie)).rowsBetween(*frame)
        return b.withColumns({o: _total([F.sum(c).over(w) for c in cs]) for o, cs in what.items()}).drop(BUCKET, KEY)
    parts = {f"{o}_{i}": c for o, cs in what.items() for i, c in enumerate(cs)}
    off = _offsets(b, by, {k: F.sum(c) for k, c in parts.items()}, zero=False)
    w = Window.partitionBy(*by, BUCKET).orderBy(*_order(descending, tie)).rowsBetween(*frame)
    res = _join_offsets(b, off, by)

    def both(k: str) -> Column:
        here, before = F.sum(parts[k]).over(w), F.col(f"_wl_off_{k}")
        return F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)

    total = {o: _total([both(f"{o}_{i}") for i in range(len(cs))]) for o, cs in what.items()}
    return res.withColumns(total).drop(BUCKET, KEY, *[f"_wl_off_{k}" for k in parts])


def segmented_sum(df: DataFrame, key: str, value: str, reset: str, out: str, *, tie: str | None = None,
                  by: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    """Running sum of ``value`` per group that starts again at 0 on every row whose boolean ``reset`` is
    true (that row's own value does not count). NULL values count 0.

    One pass over the dealt rows: inside a bucket a sum per stretch between resets; each bucket leaves
    (has it a reset, sum since its last one), and a scan over those few rows gives every bucket what is
    carried into the stretch before its first reset.
    """
    by = list(by)
    b = add_order_buckets(df, key, tie=tie, by=by, n_buckets=n_buckets)
    order = _order(False, tie)
    frame = (Window.unboundedPreceding, Window.currentRow)
    is_reset = F.coalesce(F.col(reset), F.lit(False))
    part = [*by, BUCKET]
    rows = b.withColumn("_wl_seg", F.sum(is_reset.cast("int")).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(*frame)))
    x = F.when(~is_reset, F.col(value).cast("double"))
    parts = {"_wl_a": F.coalesce(_exact_part(x), F.lit(0).cast(EXACT)), "_wl_b": F.coalesce(_other_part(x), F.lit(0.0))}
    inside = Window.partitionBy(*part, "_wl_seg").orderBy(*order).rowsBetween(*frame)
    rows = rows.withColumns(parts).withColumns({f"{p}_sum": F.sum(p).over(inside) for p in parts})
    temporary = ["_wl_seg", *parts, *[f"{p}_sum" for p in parts], BUCKET, KEY]
    if _one_bucket(b):
        return rows.withColumn(out, F.col("_wl_a_sum").cast("double") + F.col("_wl_b_sum")).drop(*temporary)
    per = rows.groupBy(*part, "_wl_seg").agg(*[F.sum(p).alias(p) for p in parts]).groupBy(*part).agg(
        F.max("_wl_seg").alias("_wl_last"), *[F.max_by(p, "_wl_seg").alias(p) for p in parts])
    before = Window.partitionBy(*by).orderBy(BUCKET)
    # stretches of buckets that begin with one that has a reset; what such a stretch has gathered so far
    per = per.withColumn("_wl_run", F.sum((F.col("_wl_last") > 0).cast("int")).over(before.rowsBetween(*frame)))
    stretch = Window.partitionBy(*by, "_wl_run").orderBy(BUCKET).rowsBetween(*frame)
    per = per.withColumns({f"{p}_so": F.sum(p).over(stretch) for p in parts})
    per = per.select(*by, BUCKET, *[F.lag(f"{p}_so").over(before).alias(f"_wl_off{p}") for p in parts])
    res = _join_offsets(rows, per, by)

    def carried(p: str) -> Column:
        return F.coalesce(F.when(F.col("_wl_seg") == 0, F.col(f"_wl_off{p}")), F.lit(0))

    return res.withColumn(out, (F.col("_wl_a_sum") + carried("_wl_a")).cast("double") + (F.col("_wl_b_sum") + carried("_wl_b"))).drop(
        *temporary, *[f"_wl_off{p}" for p in parts])


def _between(lo: Column, hi: Column, frac: Column) -> Column:
    """The one interpolation formula of all quantiles."""
    return lo + frac * (hi - lo)


def exact_quantiles(df: DataFrame, col: str, fractions: list[float], *, by: list[str] | tuple = (),
                    out: str = "q", n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles by selection; NULL and NaN are ignored.

    Above one bucket of rows nothing is sorted or shuffled but the few values around the wanted positions.
    Returns one row per group: ``by..., n, <out> array<double>``.
    """
    by = list(by)
    d = df.select(*by, F.col(col).cast("double").alias("_wl_x")).filter(F.col("_wl_x").isNotNull() & ~F.isnan("_wl_x"))
    p = n_buckets or _default_buckets(d, None, ROWS_PER_BUCKET)
    fr = F.array(*[F.lit(float(f)) for f in fractions])
    if p <= 1:
        s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.col("_wl_x") + F.lit(0.0))).alias("_s"))

        def at(f):
            h = (F.col("n") - 1).cast("double") * f
            lo = F.floor(h).cast("int")
            return _between(F.element_at("_s", lo + 1), F.element_at("_s", F.least(lo + 2, F.col("n").cast("int"))), h - lo.cast("double"))

        # a global aggregate of no rows is one row: none as for groups
        return s.filter(F.col("n") > 0).select(*by, "n", F.transform(fr, at).alias(out))
    return _selected_quantiles(d, by, fractions, out, p)


def _selected_quantiles(d: DataFrame, by: list[str], fractions: list[float], out: str, p: int) -> DataFrame:
    """Quantiles of ``_wl_x`` without a shuffle of the rows, by counting (``selection.locate``); groups above the number
    that stands as literals in a plan are ranked instead."""
    from wearline.operators import selection as S

    spark = d.sparkSession
    found = S.group_slots(d, by) if by else ([()], F.lit(0))
    if found is None:
        return _ranked_quantiles(d, by, fractions, out, p)
    groups, slot = found

    def places(n: int) -> list[tuple[int, int, float]]:
        h = [(n - 1) * f for f in fractions]
        return [(math.floor(x) + 1, min(math.floor(x) + 2, n), x - math.floor(x)) for x in h]

    def wanted(sizes):
        return [[k for lo, hi, _ in places(n) for k in (lo, hi)] if n else [] for n in sizes]

    budget = max(1, math.ceil(d.count() / p))
    at = S.cut(d, [F.col("_wl_x") + F.lit(0.0)], wanted, slot=slot, n_slots=len(groups), budget=budget)
    value = {k: v[0] for k, v in at.values.items()}
    rows = []
    for s, (g, n) in enumerate(zip(groups, at.sizes, strict=True)):
        if n:
            rows.append((*g, n, [_between(value[s, lo], value[s, hi], frac) for lo, hi, frac in places(n)]))
    kinds = [d.schema[c] for c in by] + StructType.fromDDL(f"n bigint, {out} array<double>").fields
    return spark.createDataFrame(rows, StructType(kinds))  # one row per group


def _ranked_quantiles(d: DataFrame, by: list[str], fractions: list[float], out: str, p: int) -> DataFrame:
    """For very many groups: every value's rank in its group, and the groups' few rows of interest."""
    b = global_row_number(d.withColumn("_wl_any", F.monotonically_increasing_id()), "_wl_x", tie="_wl_any", by=by, out="_k", n_buckets=p)
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    h = F.transform(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: (F.col("n") - 1).cast("double") * f)
    sizes = sizes.withColumn("_lo", F.transform(h, lambda x: F.floor(x) + 1)).withColumn("_frac", F.transform(h, lambda x: x - F.floor(x).cast("double")))
    ends = F.concat("_lo", F.transform("_lo", lambda k: F.least(k + 1, F.col("n"))))
    want = sizes.select(*by, F.explode(F.array_distinct(ends)).alias("_k"))
    kept = join_groups(b, want, by, ["_k"], "left_semi").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_wl_x"))).alias("_at"))
    both = join_groups(sizes, kept, by)

    def value(lo, frac):
        return _between(F.element_at("_at", lo), F.element_at("_at", F.least(lo + 1, F.col("n"))), frac)

    return both.select(*by, "n", F.zip_with("_lo", "_frac", value).alias(out))


def rolling_window(df: DataFrame, key: str, exprs, window: int, by: list[str] | tuple,
                   n_buckets: int | None = None) -> DataFrame:
    """Rows frame ``[-(window - 1), 0]`` per group in ``key`` order, exact, skew-safe.

    ``exprs(w)`` returns ``{name: Column}`` over the window spec ``w``. Inputs above one bucket are
    cut into key ranges; each bucket also receives the ``window - 1`` rows that precede it in its
    group (its halo: the last rows of the buckets before it, so that only those few rows move), the frame is
    evaluated per bucket and halo rows are dropped, so a unit holding a third of all rows is spread over
    many tasks and every frame still sees exactly its preceding rows. ``key`` must be
    unique within a group (a cycle number, a timestamp with tie-free ticks).
    """
    by = list(by)
    b = add_order_buckets(df, key, by=by, n_buckets=n_buckets)
    if _one_bucket(b) or window < 2:  # a frame of one row needs no neighbours
        part = [] if _one_bucket(b) else [BUCKET]
        return b.withColumns(exprs(Window.partitionBy(*by, *part).orderBy(*_order(False, None)).rowsBetween(-(window - 1), Window.currentRow))).drop(BUCKET, KEY)
    # groups x buckets: where each bucket begins, and the later buckets of its group whose first frames reach back into it
    per = b.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_wl_n"))
    order = Window.partitionBy(*by).orderBy(BUCKET)
    per = per.withColumn("_wl_off", F.coalesce(F.sum("_wl_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = F.collect_list(F.struct(F.col(BUCKET).alias("b"), F.col("_wl_off").alias("o"))).over(order.rowsBetween(1, window - 1))
    per = stage(per.withColumn("_wl_to", later), "offsets")
    # halo: the last window - 1 rows of a bucket, relabelled to the buckets that need them
    rows = b.columns
    last = F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(*_order(False, None))) + F.col("_wl_off")
    halo = join_groups(b, per, by, [BUCKET]).withColumn("_wl_rn", last).filter(F.col("_wl_rn") > F.col("_wl_off") + F.col("_wl_n") - (window - 1))
    halo = halo.withColumn("_wl_t", F.explode("_wl_to")).filter(F.col("_wl_rn") > F.col("_wl_t.o") - (window - 1))
    halo = halo.withColumn(BUCKET, F.col("_wl_t.b")).select(*rows).withColumn("_wl_halo", F.lit(True))
    both = b.withColumn("_wl_halo", F.lit(False)).unionByName(halo)
    wb = Window.partitionBy(*by, BUCKET).orderBy(*_order(False, None)).rowsBetween(-(window - 1), Window.currentRow)
    return both.withColumns(exprs(wb)).filter(~F.col("_wl_halo")).drop(BUCKET, KEY, "_wl_halo")
