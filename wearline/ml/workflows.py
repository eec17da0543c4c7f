"""End-to-end model workflows built from the operators: benchmark (A26), per-mode models
(M13), split robustness (M2 + A17), feature-set delta (A25), RUL regression (M10 + M18),
dataset fingerprint (A27)."""

from __future__ import annotations

import math
import platform
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import failure_label, round4, safe_div0
from wearline.ml import boosting
from wearline.ml import estimators as P
from wearline.ml import forest
from wearline.ml.parallel import side_by_side
from wearline.ml.split import stratified_split
from wearline.operators import features, metrics
from wearline.operators.rank import global_row_number
from wearline.session import ensure_checkpoint_dir, stage


def split_frames(df: DataFrame, label: str = "machine_failure", seed: int = C.RANDOM_SEED,
                 weight_mode: str = "balanced"):
    """Stratified 80/20 split; training rows carry a class-weight column.

    Both sides are checkpointed to the shared ``spark.checkpoint.dir``: iterative solvers
    read them many times, the lineage (split ranks, weights) is cut, and a lost executor
    re-reads the files instead of recomputing the split."""
    ensure_checkpoint_dir(df.sparkSession)  # the session's shared folder (set only when unset)
    s = stage(stratified_split(stage(df, "rows"), label=label, seed=seed), "split")
    train = features.class_weights(s.filter("is_test = 0"), label, mode=weight_mode)
    test = s.filter("is_test = 1")
    return train.checkpoint(eager=True), test.checkpoint(eager=True)


#: rows of a part that an iterative solver may go through alone
PART_ROWS = 20_000


def spread(train: DataFrame) -> DataFrame:
    """Training rows for solvers that read them many times: a split of few files is dealt to as many parts as the cluster works on at
    once, none of them for less than ``PART_ROWS`` rows. A forest draws its bootstrap by part."""
    parts = min(-(-train.count() // PART_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    return train.repartition(parts).checkpoint(eager=True) if parts > train.rdd.getNumPartitions() else train


def fit_score(kind: str, train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str],
              label: str = "machine_failure", weight: str | None = "weight", **params):
    """Fit one model and score the test rows; returns (model, scored, seconds). ``histogram`` is the library's own booster
    (``params`` are those of ``boosting.Spec``), ``deep_forest`` its own forest of full depth, or Spark's where the table is too large for a
    task; every other kind is a Spark pipeline."""
    if kind == "histogram":
        t0 = time.perf_counter()
        (model,) = boosting.fit(train, numeric, categorical, [boosting.Spec(label, weight=weight, **params)])
        secs = time.perf_counter() - t0
        return model, P.positive_probability(model.transform(test)), secs
    if kind == "deep_forest":
        t0 = time.perf_counter()
        model = forest.fit(train, numeric, categorical, label, weight, max_depth=P.DEEPEST, **params)
        if model:
            return model, P.positive_probability(model.transform(test)), time.perf_counter() - t0
        kind, params = "forest", {"maxDepth": P.DEEPEST}
    est = P.classifier(kind, label=label, weight=weight, **params)
    pipe = P.build(numeric, categorical, est)
    t0 = time.perf_counter()
    model = pipe.fit(train)
    secs = time.perf_counter() - t0
    return model, P.positive_probability(model.transform(test)), secs


def benchmark(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str],
              label: str = "machine_failure", id_col: str = "product_id") -> DataFrame:
    """Prior, logistic, forest and boosting on the same split; one metric row per model. The forest grows as deep as Spark
    allows (its trees end before: 26 levels on 8,000 rows)."""
    train = spread(train)
    parts, secs = [], {}
    prior = P.prior_scores(train, test, label)
    parts.append(prior.select(id_col, label, "score", F.lit("dummy_baseline").alias("model")))
    secs["dummy_baseline"] = 0.0
    for name, kind, w, params in (("logistic_regression", "logistic", "weight", {}), ("random_forest", "deep_forest", "weight", {}),
                                  ("hist_gradient_boosting", "histogram", None, {"max_depth": 5})):
        _, scored, s = fit_score(kind, train, test, numeric, categorical, label, w, **params)
        parts.append(scored.select(id_col, label, "score", F.lit(name).alias("model")))
        secs[name] = s
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    mm = metrics.model_metrics(allp, label, "score", by=["model"])
    t = allp.sparkSession.createDataFrame([(k, float(v)) for k, v in secs.items()], "model string, training_seconds double")
    return mm.join(t, "model", "left").select(*mm.columns, round4("training_seconds").alias("training_seconds"))


def per_mode_models(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str],
                    flag_cols: dict[str, str] | None = None, id_col: str = "product_id",
                    min_positives: int = C.MIN_MODE_POSITIVES, fraction: float = C.PRIMARY_REVIEW_FRACTION, **params) -> DataFrame:
    """One weighted boosting model per failure mode (modes with < 5 training positives
    are skipped); metrics and capture at the 10 % budget in one grouped pass over the union."""
    flag_cols = flag_cols or {c: c.lower() for c in C.FAILURE_CODES}
    pos = train.agg(*[F.sum(F.col(c)).cast("bigint").alias(code) for code, c in flag_cols.items()]).first()

    modes = [(code, col) for code, col in flag_cols.items() if (pos[code] or 0) >= min_positives]
    if not modes:
        return train.sparkSession.createDataFrame([], "failure_code string")
    weighted = train.drop("weight")
    for _, col in modes:
        weighted = features.class_weights(weighted, col, mode="ratio").withColumnRenamed("weight", f"_weight_{col}")
    specs = [boosting.Spec(col, weight=f"_weight_{col}", **{"max_depth": 4, "min_leaf": 5, **params}) for _, col in modes]
    models = boosting.fit(weighted, numeric, categorical, specs)  # all modes together
    parts = [P.positive_probability(model.transform(test)).select(id_col, F.col(col).alias("y"), "score", F.lit(code).alias("failure_code"),
                                                                  F.lit(int(pos[code])).cast("bigint").alias("train_failures"))
             for (code, col), model in zip(modes, models, strict=True)]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return mode_report(allp, id_col, fraction)


def mode_report(allp: DataFrame, id_col: str = "product_id", fraction: float = C.PRIMARY_REVIEW_FRACTION) -> DataFrame:
    """M13's table for scored holdouts ``failure_code, id, y, score, train_failures`` of all modes: metrics and the
    capture of each mode's own queue."""
    rm = metrics.binary_metrics_from_confusion(metrics.ranking_metrics(allp, "y", "score", by=["failure_code"]))
    # capture at the budget: exact per-mode rank by score (bucketed), n = max(1, ceil(N f))
    ranked = global_row_number(allp, "score", descending=True, tie=id_col, by=["failure_code"], out="_r")
    sizes = allp.groupBy("failure_code").agg(F.count(F.lit(1)).alias("_rows"))  # a row per mode
    cap = (ranked.join(sizes, "failure_code").withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_rows") * F.lit(float(fraction)))))
           .groupBy("failure_code").agg(
               F.first("train_failures").alias("train_failures"),
               F.sum("y").cast("bigint").alias("holdout_failures"),
               F.sum(F.when(F.col("_r") <= F.col("_n"), F.col("y")).otherwise(0)).cast("bigint").alias("_cap")))
    out = rm.join(cap, "failure_code", "inner")
    total_ok = (F.col("holdout_failures") > 0)
    return out.select(
        "failure_code", failure_label(F.col("failure_code")).alias("label"), "train_failures", "holdout_failures",
        F.when(total_ok & (F.col("holdout_failures") < F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")),
               round4("roc_auc")).alias("roc_auc"),
        F.when(total_ok, round4("average_precision")).alias("pr_auc"),
        "precision", "recall", "f1",
        round4(safe_div0(F.col("_cap"), F.col("holdout_failures"))).alias("capture_rate_at_10pct_budget"))


def robustness(df: DataFrame, numeric: list[str], categorical: list[str], seeds: list[int] | None = None,
               label: str = "machine_failure", id_col: str = "product_id", **params):
    """M2: refit on independent stratified splits, all of them in one fit (a seed's holdout has no label in that seed's
    model); the scored holdouts are unioned (seed as a column) and evaluated in one grouped pass; A17 mean / population std."""
    seeds = seeds or C.ROBUSTNESS_SEEDS
    d = stage(df, "rows")  # read by every split
    for seed in seeds:
        d = stratified_split(d, label=label, id_col=id_col, seed=seed).withColumnRenamed("is_test", f"_test_{seed}")
    d = stage(d.withColumns({f"_y_{s}": F.when(F.col(f"_test_{s}") == 0, F.col(label)) for s in seeds}), "splits")
    models = boosting.fit(d, numeric, categorical, [boosting.Spec(f"_y_{s}", **params) for s in seeds])
    scored_all = None
    for seed, model in zip(seeds, models, strict=True):
        part = P.positive_probability(model.transform(d.where(f"_test_{seed} = 1"))).select(id_col, label, "score", F.lit(seed).alias("split_seed"))
        scored_all = part if scored_all is None else scored_all.unionByName(part)
    return seed_metrics(scored_all, label)


def seed_metrics(scored_all: DataFrame, label: str = "machine_failure", score: str = "score"):
    """The metrics of every split, and A17 over them."""
    per = metrics.model_metrics(scored_all, label, score, by=["split_seed"]).select("split_seed", "roc_auc", "pr_auc", "f1")
    return per, metrics.mean_and_pop_std(per, ["roc_auc", "pr_auc"])


def feature_delta(train: DataFrame, test: DataFrame, raw: list[str], enhanced: list[str],
                  categorical: list[str], label: str = "machine_failure", **params) -> DataFrame:
    """Same parameters, raw vs enhanced features; delta = enhanced - raw."""
    def one(named):
        name, cols = named
        _, scored, _ = fit_score("histogram", train, test, cols, categorical, label, None, **params)
        m = metrics.model_metrics(scored, label, "score", by=[])
        return m.select(F.lit(name).alias("feature_set"), "roc_auc", "pr_auc", "f1")

    out = side_by_side(train.sparkSession, one, [("raw_features", raw), ("enhanced_features", enhanced)])
    return metric_delta(out[0].unionByName(out[1]))


def metric_delta(both: DataFrame) -> DataFrame:
    """Two rows of metrics (``feature_set``) side by side with their differences."""
    wide = both.agg(*[F.max(F.when(F.col("feature_set") == s, F.col(c))).alias(f"{s}_{c}")
                      for s in ("raw_features", "enhanced_features") for c in ("roc_auc", "pr_auc", "f1")])
    return wide.select(*[round4(F.col(f"enhanced_features_{c}") - F.col(f"raw_features_{c}")).alias(f"delta_{c}")
                         for c in ("roc_auc", "pr_auc", "f1")], *wide.columns)


def encoded_value(df: DataFrame, c: str) -> Column:
    """One value as text that no other value has: ``n`` for NULL, otherwise a letter for its kind, the length of its text, a colon
    and the text. A double is its exact significand (53 bits) and exponent of two, so that equal texts are equal bits."""
    kind, x = df.schema[c].dataType.simpleString(), F.col(c)
    if kind in ("double", "float"):
        x, size = x.cast("double"), F.abs(F.col(c).cast("double"))
        guess = F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0))))
        scaled = _times_two_to(size, -guess)
        e = guess + (scaled >= 2).cast("int") - (scaled < 1).cast("int")
        digits = _times_two_to(size, F.lit(52) - e).cast("bigint").cast("string")
        text = F.when(F.isnan(x), F.lit("nan")).when(size == math.inf, F.lit("inf")).when(x == 0, F.lit("0")).otherwise(F.concat(digits, F.lit("p"), e.cast("string")))
        letter, text = F.lit("d"), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text)
    else:
        letter, text = F.lit("s" if kind == "string" else "t" if kind.startswith(("date", "timestamp")) else "i"), x.cast("string")
    return F.when(x.isNull(), F.lit("n")).otherwise(F.concat(letter, F.octet_length(text).cast("string"), F.lit(":"), text))


def _times_two_to(x: Column, k: Column) -> Column:
    """x * 2**k in two exact steps, neither of which over- or underflows where the result does not."""
    half = F.floor(k / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), k - half)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-free dataset hash, which any engine can repeat: SHA-256 of ``rows:a:b``, where a and b are the
    sums over all rows of two disjoint 60-bit parts of the MD5 of the row's encoded values."""
    columns = columns or df.columns
    h = F.md5(F.concat(*[encoded_value(df, c) for c in columns]).cast("binary"))
    sums = [F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(n) for n, at in (("_a", 1), ("_b", 16))]
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *sums)
    return agg.select("rows", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("rows", "_a", "_b")]).cast("binary"), 256).alias("sha256"))


def model_card(df: DataFrame, columns: list[str], dataset: str, seed: int = C.RANDOM_SEED) -> DataFrame:
    """The fingerprint with dataset name, seed, library versions and time of the run."""
    return fingerprint(df, columns).select(
        F.lit(dataset).alias("dataset"), "rows", "sha256", F.lit(seed).alias("seed"),
        F.lit(df.sparkSession.version).alias("spark_version"), F.lit(platform.python_version()).alias("python_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("computed_at_utc"))
