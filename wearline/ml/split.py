"""M1 stratified holdout, M3 stratified folds, M4 group folds — reproducible in SQL.

Order inside a stratum is ``(substr(md5(id || ':' || seed), 1, 15), id)``; Spark and
DuckDB agree on md5, so the oracle SQL reproduces the split row for row. The holdout is a
threshold found by counting; folds need every rank, by the bucketed exact rank: a class
holding 97 % of the rows is spread over many tasks.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.operators import rank
from wearline.operators import selection as S
from wearline.operators.rank import global_row_number


def hash_key(id_col: str, seed: int) -> Column:
    """60-bit integer whose order equals the order of the first 15 md5 hex digits."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str = "machine_failure", id_col: str = "product_id",
                     test_size: float = C.TEST_SIZE, seed: int = C.RANDOM_SEED,
                     n_buckets: int | None = None) -> DataFrame:
    """Add ``is_test`` (int): the first round(test_size * n_class) rows of each class by hash order.

    The last such row of every class is found by counting (``selection.cut``) and stands as a literal threshold in the
    plan: the table is neither shuffled nor sorted. Rows without a label are a class; rows that share an id fall on
    the same side. More than 64 classes, or ids that counting has no intervals for, are ranked."""
    keyed = df.withColumn("_wl_hk", hash_key(id_col, seed))
    keys = S.order_keys(keyed, "_wl_hk", tie=id_col)
    found = S.group_slots(keyed, [label]) if keys else None
    if found is None:
        return _ranked_split(keyed, df, label, id_col, test_size, n_buckets)
    classes, slot = found
    budget = rank.ROWS_PER_BUCKET if not n_buckets else max(1, -(-df.count() // n_buckets))

    def sizes_of_test(sizes):
        return [int(Decimal(repr(float(test_size) * n)).quantize(Decimal(1), ROUND_HALF_UP)) for n in sizes]

    ends = S.cut(keyed, keys, lambda sizes: [[k] for k in sizes_of_test(sizes)], slot=slot, n_slots=len(classes), budget=budget)
    inside = F.lit(False)
    for n, k in enumerate(sizes_of_test(ends.sizes)):
        if k:
            inside = F.when(slot == n, ends.before(n, k) | ends.level(n, k)).otherwise(inside)
    return keyed.withColumn("is_test", inside.cast("int")).drop("_wl_hk")


def _ranked_split(keyed: DataFrame, df: DataFrame, label: str, id_col: str, test_size: float, n_buckets: int | None) -> DataFrame:
    ranked = global_row_number(keyed, "_wl_hk", tie=id_col, by=[label], out="_wl_r", n_buckets=n_buckets)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_wl_nc"))  # one row per class
    n_test = F.round(F.lit(float(test_size)) * F.col("_wl_nc"), 0).cast("bigint")
    sizes = sizes.withColumnRenamed(label, "_wl_class")
    return (ranked.join(sizes, ranked[label].eqNullSafe(F.col("_wl_class")), "inner").drop("_wl_class")
            .withColumn("is_test", (F.col("_wl_r") <= n_test).cast("int"))
            .drop("_wl_hk", "_wl_r", "_wl_nc"))


def stratified_folds(train: DataFrame, label: str = "machine_failure", id_col: str = "product_id",
                     k: int = C.CV_FOLDS, seed: int = C.RANDOM_SEED, n_buckets: int | None = None) -> DataFrame:
    """M3: ``fold`` = (rank in stratum by hash order - 1) mod k: classes spread evenly."""
    keyed = train.withColumn("_wl_hk", hash_key(id_col, seed))
    ranked = global_row_number(keyed, "_wl_hk", tie=id_col, by=[label], out="_wl_r", n_buckets=n_buckets)
    return ranked.withColumn("fold", ((F.col("_wl_r") - 1) % k).cast("int")).drop("_wl_hk", "_wl_r")


def group_fold(unit_col: str, k: int = C.CV_FOLDS, salt: str = "") -> Column:
    """M4: fold from the unit key alone, so a unit never spans folds; folds of different salts are independent."""
    h = F.substring(F.md5(F.concat(F.col(unit_col).cast("string"), F.lit(salt))), 1, 8)
    return (F.conv(h, 16, 10).cast("bigint") % k).cast("int")


def group_folds(df: DataFrame, unit_col: str = "unit_number", k: int = C.CV_FOLDS, salt: str = "") -> DataFrame:
    """M4: ``fold`` per unit, a unit never in two folds, folds of nearly equal row counts.

    The units (a row each, with their row counts) are ordered by size, the largest first, ties by a hash of unit and salt, and
    dealt in serpentine order 0 .. k-1, k-1 .. 0 and so on, so folds differ by at most one largest unit. Rows of a NULL unit
    are a unit. Only the unit table is ranked; the rows are joined to it."""
    sizes = df.groupBy(unit_col).agg(F.count(F.lit(1)).alias("_wl_n"))
    h = F.md5(F.concat(F.coalesce(F.col(unit_col).cast("string"), F.lit("")), F.lit(salt)))
    order = F.struct((-F.col("_wl_n")).alias("n"), h.alias("h"), F.col(unit_col).alias("u"))
    dealt = global_row_number(sizes.withColumn("_wl_at", order), "_wl_at", out="_wl_r")
    place = (F.col("_wl_r") - 1) % (2 * k)
    fold = F.when(place < k, place).otherwise(2 * k - 1 - place).cast("int")
    return rank.join_groups(df, dealt.select(unit_col, fold.alias("fold")), [unit_col])


def background_sample(df: DataFrame, n: int = C.BACKGROUND_SIZE, id_col: str = "product_id",
                      seed: int = C.RANDOM_SEED) -> DataFrame:
    """At most ``n`` rows without replacement, reproducible: the first n in hash order.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject (n rows per task); the limit
    is the sampling operator itself."""
    return df.withColumn("_wl_hk", hash_key(id_col, seed)).orderBy("_wl_hk", id_col).limit(n).drop("_wl_hk")
