"""Population Stability Index drift checks: A13 PSI from counts, A14 numeric PSI,
A15 categorical PSI, A16 drift report, U4 exact-n bootstrap sample, P10 verdicts.

The breakpoints are fixed first (one grouped exact quantile; features x 11 numbers come to the
driver, a bound that does not depend on the data) and stand in the next plan as literals: one
partial-and-final aggregate over both sides then counts every bin of every feature. NaN counts as NULL.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import psi_verdict, round4
from wearline.operators import rank
from wearline.operators import selection as S
from wearline.operators.rank import exact_quantiles, global_row_number, quantile_grid

REF, CUR = 0, 1


def breakpoints(reference: DataFrame, features: list[str], buckets: int = C.PSI_BUCKETS,
                n_buckets: int | None = None) -> dict[str, list[float]]:
    """Interior breakpoints per feature: the reference's distinct quantiles without the two ends, which
    are opened. Features with fewer than three distinct quantiles are left out."""
    sel = reference.select(*[F.col(c).cast("double").alias(c) for c in features])
    fr = quantile_grid(buckets, percent=True)  # pandas quantile goes through numpy percentile
    q = exact_quantiles(sel.unpivot([], features, "feature", "value"), "value", fr, by=["feature"], n_buckets=n_buckets)
    out = {}
    for r in q.collect():  # features x (buckets + 1) numbers
        bp = sorted(set(r["q"]))
        if len(bp) >= 3:
            out[r["feature"]] = bp[1:-1]
    return {f: out[f] for f in features if f in out}


def bin_counts(bp: dict[str, list[float]], when: dict[str, Column | None]) -> list[Column]:
    """Aggregates ``<name>__<feature>__<bin>``: rows of each bin [a, b), for each named condition."""
    out = []
    for name, cond in when.items():
        for f, interior in bp.items():
            edges = [-math.inf, *interior, math.inf]
            x = F.col(f).cast("double")
            known = x.isNotNull() & ~F.isnan(x)
            for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                inside = known if cond is None else known & cond
                inside = inside if lo == -math.inf else inside & (x >= F.lit(lo))
                inside = inside if hi == math.inf else inside & (x < F.lit(hi))
                out.append(F.count_if(inside).alias(f"{name}__{f}__{i}"))
    return out


def bin_of(x: Column, interior: list[float]) -> Column:
    """The bin [a, b) of a value as comparisons with literals, halving the breakpoints; NULL and NaN have none."""
    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(float(interior[mid])), below(lo, mid)).otherwise(below(mid + 1, hi))

    return F.when(x.isNotNull() & ~F.isnan(x), below(0, len(interior)))


def _psi_term() -> F.Column:
    """A13 term per bin over clipped shares: (c - r) * ln(c / r)."""
    r = F.col("ref_share")
    c = F.col("cur_share")
    return (c - r) * F.log(c / r)


def _clip(x: F.Column) -> F.Column:
    return F.when(x < F.lit(C.PSI_EPS), F.lit(C.PSI_EPS)).otherwise(x)


def _psi_from_cells(cells: DataFrame) -> DataFrame:
    """A13 over a small cell table (feature, ref_n, cur_n, ref_total, cur_total)."""
    shares = cells.withColumns({
        "ref_share": _clip(F.col("ref_n") / F.greatest(F.col("ref_total"), F.lit(1)).cast("double")),
        "cur_share": _clip(F.col("cur_n") / F.greatest(F.col("cur_total"), F.lit(1)).cast("double")),
    })
    return shares.groupBy("feature").agg(
        F.sum(_psi_term()).alias("_psi"),
        F.min(F.least(F.col("ref_total"), F.col("cur_total"))).alias("_minside"))


def _with_names(spark, features: list[str], per: DataFrame, psi: F.Column) -> DataFrame:
    names = spark.createDataFrame([(f,) for f in features], "feature string")  # the feature list
    return names.join(per.select("feature", psi.alias("psi")), "feature", "left").select(
        "feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def _both(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    return reference.select(*features, F.lit(REF).alias("_side")).unionByName(current.select(*features, F.lit(CUR).alias("_side")))


def _numeric_cells(reference: DataFrame, current: DataFrame, features: list[str], buckets: int,
                   n_buckets: int | None) -> DataFrame | None:
    bp = breakpoints(reference, features, buckets, n_buckets)
    if not bp:
        return None
    places = [F.struct(F.lit(f).alias("feature"), bin_of(F.col(f).cast("double"), interior).alias("bin")) for f, interior in bp.items()]
    binned = _both(reference, current, list(bp)).select("_side", F.inline(F.array(*places))).filter(F.col("bin").isNotNull())
    counts = binned.groupBy("feature", "bin").agg(F.count_if(F.col("_side") == REF).alias("ref_n"), F.count_if(F.col("_side") == CUR).alias("cur_n"))
    grid = reference.sparkSession.createDataFrame(  # features x bins: empty ones count too
        [(f, i) for f, interior in bp.items() for i in range(len(interior) + 1)], "feature string, bin int")
    cells = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["ref_n", "cur_n"])
    wf = Window.partitionBy("feature")  # over the small cell table
    return cells.withColumns({"ref_total": F.sum("ref_n").over(wf), "cur_total": F.sum("cur_n").over(wf)})


def numeric_psi(reference: DataFrame, current: DataFrame, features: list[str],
                buckets: int = C.PSI_BUCKETS, n_buckets: int | None = None) -> DataFrame:
    """Feature, psi (unrounded). NULL and NaN dropped; reference quantile breakpoints, unique, both
    ends opened; bins [a, b); fewer than 3 breakpoints or an empty side -> 0."""
    cells = _numeric_cells(reference, current, features, buckets, n_buckets)
    if cells is None:
        return reference.sparkSession.createDataFrame([(f, 0.0) for f in features], "feature string, psi double")
    per = _psi_from_cells(cells)
    return _with_names(reference.sparkSession, features, per, F.when(F.col("_minside") > 0, F.col("_psi")).otherwise(F.lit(0.0)))


def categorical_psi(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """PSI over the union of categories; totals include NULL rows (one grouped count)."""
    sel = _both(reference, current, features).select("_side", *[F.col(c).cast("string").alias(c) for c in features])
    wide = sel.unpivot(["_side"], features, "feature", "category").groupBy("feature", "category").agg(
        F.count_if(F.col("_side") == REF).alias("ref_n"), F.count_if(F.col("_side") == CUR).alias("cur_n"))
    wf = Window.partitionBy("feature")  # categories per feature: a small table
    cells = (wide.withColumns({"ref_total": F.sum("ref_n").over(wf), "cur_total": F.sum("cur_n").over(wf)})
             .filter(F.col("category").isNotNull()))
    per = _psi_from_cells(cells)
    return _with_names(reference.sparkSession, features, per, F.col("_psi"))


def psi_all(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str],
            buckets: int = C.PSI_BUCKETS, n_buckets: int | None = None) -> DataFrame:
    """Feature, psi (unrounded) for numeric and categorical features; one aggregate each.
    Numeric totals drop NULLs and an empty side gives 0; categorical totals count NULL rows (the
    reference's semantics for each)."""
    out = numeric_psi(reference, current, numeric, buckets, n_buckets)
    return out.unionByName(categorical_psi(reference, current, categorical)) if categorical else out


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str],
                 n_buckets: int | None = None) -> DataFrame:
    """A16 long form: feature, psi (4 places), verdict."""
    allp = psi_all(reference, current, numeric, categorical, n_buckets=n_buckets)
    return allp.select("feature", round4("psi").alias("psi"), psi_verdict(F.col("psi")).alias("verdict"))


def drift_summary(report: DataFrame, reference: DataFrame, current: DataFrame) -> DataFrame:
    """A16 summary row: row counts, flag, drifted features in psi-desc order."""
    drifted = report.filter(F.col("verdict") != C.VERDICT_NONE)
    agg = drifted.agg(F.count(F.lit(1)).alias("n_drifted"),
                      F.sort_array(F.collect_list(F.struct((-F.col("psi")).alias("k"), F.col("feature"))))
                      .alias("_d"))  # at most one entry per feature
    rows = reference.agg(F.count(F.lit(1)).alias("reference_rows")).crossJoin(
        F.broadcast(current.agg(F.count(F.lit(1)).alias("live_batch_rows"))))  # one row each
    return rows.crossJoin(F.broadcast(agg)).select(  # one row each
        "reference_rows", "live_batch_rows", (F.col("n_drifted") > 0).alias("drift_detected"), "n_drifted",
        F.concat_ws("|", F.transform("_d", lambda s: s["feature"])).alias("drifted_features"))


def bootstrap_sample(df: DataFrame, n: int, seed: int = C.RANDOM_SEED, id_col: str = "product_id",
                     n_buckets: int | None = None) -> DataFrame:
    """U4: exactly ``n`` rows drawn with replacement, reproducible (and in SQL).

    Draw j = 0..n-1 picks ordinal (md5(j:seed) prefix mod N) + 1 of the id order. The drawn rows are found by counting
    (``selection.locate``): only the neighbours of a drawn row are ranked, the table is not shuffled.
    """
    spark = df.sparkSession

    def ordinals(total: int) -> list[int]:
        return [int(hashlib.md5(f"{j}:{seed}".encode()).hexdigest()[:15], 16) % max(total, 1) + 1 for j in range(n)]

    keys = S.order_keys(df, id_col)
    if keys is None:  # ids of a type that counting has no intervals for
        total = df.count()
        rows = global_row_number(df, id_col, out="_wl_ord", n_buckets=n_buckets, n_rows=total)
    else:
        budget = rank.ROWS_PER_BUCKET if not n_buckets else max(1, -(-df.count() // n_buckets))
        at = S.locate(df, keys, lambda sizes: [ordinals(sizes[0])], budget=budget)
        total, rows = at.sizes[0], S.rows_at(at, df.columns, "_wl_ord").drop("slot")
    draws = spark.createDataFrame([(k,) for k in ordinals(total)], "_wl_ord bigint")  # n rows, a parameter
    return rows.join(F.broadcast(draws), "_wl_ord", "inner").drop("_wl_ord")


def reference_histogram(reference: DataFrame, features: list[str], buckets: int = C.PSI_BUCKETS,
                        n_buckets: int | None = None) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """Frozen reference for windowed drift (R5): interior breakpoints and bin shares per feature (empty
    bins share 0), as plain numbers whose count is fixed by features and buckets."""
    bp = breakpoints(reference, features, buckets, n_buckets)
    if not bp:
        return {}, {}
    row = reference.agg(*bin_counts(bp, {"r": None})).first()
    shares = {}
    for f, interior in bp.items():
        n = [row[f"r__{f}__{i}"] for i in range(len(interior) + 1)]
        shares[f] = [v / float(max(sum(n), 1)) for v in n]
    return bp, shares


def dropped_columns(all_cols: DataFrame, kept: DataFrame, col: str = "sensor") -> DataFrame:
    """The set difference of column names (e.g. sensors dropped as near-constant)."""
    return all_cols.select(col).exceptAll(kept.select(col))
