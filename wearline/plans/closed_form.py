"""Model operators over closed-form scorers: splits, preprocessing, priors, importance, deltas and per-mode reports do not
depend on a solver, so DuckDB repeats them value by value. The fitted twins are in ``plans/models.py``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wearline.functions import constants as C
from wearline.functions.columns import round4
from wearline.ml import estimators as P
from wearline.ml import workflows as W
from wearline.ml.importance import permutation_importance
from wearline.ml.split import stratified_split
from wearline.operators import metrics
from wearline.plans.registry import register
from wearline.plans.snapshot import SPLIT_SQL, auc_ap_sql
from wearline.plans.views import READINGS, with_
from wearline.session import stage
from wearline.sources.adapters import CATEGORICAL_FEATURES, NUMERIC_FEATURES, readings


def risk_of(values):
    """x / (1 + x) with x = torque * wear / 11000, as a function of a row's features."""
    x = values["torque_nm"] * values["tool_wear_min"] / 11000.0
    return x / (1.0 + x)


def _risk_sql(torque: str, wear: str) -> str:
    x = f"({torque} * {wear} / 11000.0::DOUBLE)"
    return f"{x} / (1.0 + {x})"


def _rows(spark, sf_dir):
    """The readings, staged: splits and quantiles read them many times, and the parsing of the events stays out of their plans."""
    return stage(readings(spark, sf_dir), "readings")


def _split(spark, sf_dir):
    s = stage(stratified_split(_rows(spark, sf_dir)), "split")
    return s.where("is_test = 0"), s.where("is_test = 1")


# --- M15 -------------------------------------------------------------------------------------------

_PERMUTED = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, r, y, {_risk_sql('d_torque_nm' if f == 'torque_nm' else 'torque_nm', 'd_tool_wear_min' if f == 'tool_wear_min' else 'tool_wear_min')} AS score FROM pairs"
    for f in NUMERIC_FEATURES)


@register("closed_form_importance", ids="M15 A7 T4", oracle=with_(READINGS, SPLIT_SQL) + f"""
, held AS (SELECT product_id, machine_failure AS y, {', '.join(NUMERIC_FEATURES)}, row_number() OVER (ORDER BY product_id) AS o FROM split WHERE is_test = 1),
don AS (
    SELECT r, {', '.join(f'{f} AS d_{f}' for f in NUMERIC_FEATURES)},
           row_number() OVER (PARTITION BY r ORDER BY substr(md5(concat_ws(':', product_id, r, '{C.RANDOM_SEED}')), 1, 15), product_id) AS o
    FROM held, (SELECT unnest(range({C.PERMUTATION_REPEATS})) AS r)),
pairs AS (SELECT * FROM held JOIN don USING (o)),
rs AS (SELECT feature || ':' || r AS variant, y, score FROM ({_PERMUTED}) UNION ALL SELECT 'base', y, {_risk_sql('torque_nm', 'tool_wear_min')} FROM held),
{auc_ap_sql("rs", "variant")}
SELECT split_part(variant, ':', 1) AS feature, round((SELECT average_precision FROM auc WHERE variant = 'base') - avg(average_precision), 4) AS importance
FROM auc WHERE variant <> 'base' GROUP BY 1""")
def q_closed_form_importance(spark, sf_dir):
    _, test = _split(spark, sf_dir)
    imp = permutation_importance(risk_of, test, NUMERIC_FEATURES)
    return imp.select("feature", round4("importance").alias("importance"))


# --- M2, A17 ---------------------------------------------------------------------------------------

_SPLITS = " UNION ALL ".join(f"""SELECT {seed} AS split_seed, machine_failure AS y, risk AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_failure ORDER BY substr(md5(CAST(product_id AS VARCHAR) || ':{seed}'), 1, 15), product_id)
              <= CAST(round({C.TEST_SIZE!r}::DOUBLE * count(*) OVER (PARTITION BY machine_failure)) AS BIGINT) AS held FROM readings) WHERE held""" for seed in C.ROBUSTNESS_SEEDS)


@register("closed_form_robustness", ids="M2 A17", oracle=with_(READINGS) + f"""
, rs AS ({_SPLITS}),
{auc_ap_sql("rs", "split_seed")},
per AS (SELECT split_seed, round(roc_auc, 4) AS roc_auc, round(average_precision, 4) AS pr_auc FROM auc)
SELECT CAST(split_seed AS INTEGER) AS split_seed, roc_auc, pr_auc, round(avg(roc_auc) OVER (), 4) AS roc_auc_mean, round(stddev_pop(roc_auc) OVER (), 4) AS roc_auc_std,
       round(avg(pr_auc) OVER (), 4) AS pr_auc_mean, round(stddev_pop(pr_auc) OVER (), 4) AS pr_auc_std
FROM per""")
def q_closed_form_robustness(spark, sf_dir):
    """The holdouts of five independent stratified splits, scored and summarised as the refitted models are."""
    rows = _rows(spark, sf_dir)
    parts = [stratified_split(rows, seed=seed).where("is_test = 1").select("product_id", "machine_failure", F.col("risk").alias("score"), F.lit(seed).alias("split_seed")) for seed in C.ROBUSTNESS_SEEDS]
    per, summary = W.seed_metrics(stage(reduce(lambda a, b: a.unionByName(b), parts), "holdouts"))
    return per.drop("f1").crossJoin(F.broadcast(summary))  # one row


# --- A25 -------------------------------------------------------------------------------------------

@register("closed_form_delta", ids="A25", oracle=with_(READINGS, SPLIT_SQL) + f"""
, rs AS (
    SELECT 'raw_features' AS s, machine_failure AS y, torque_nm / 100.0::DOUBLE AS score FROM split WHERE is_test = 1
    UNION ALL SELECT 'enhanced_features', machine_failure, risk FROM split WHERE is_test = 1),
{auc_ap_sql("rs", "s")},
f AS (SELECT s, sum(CASE WHEN score >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN score < 0.5 THEN y ELSE 0 END) AS fn FROM rs GROUP BY s),
m AS (SELECT s, round(roc_auc, 4) AS roc_auc, round(average_precision, 4) AS pr_auc, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1 FROM auc JOIN f USING (s)),
r AS (SELECT * FROM m WHERE s = 'raw_features'), e AS (SELECT * FROM m WHERE s = 'enhanced_features')
SELECT round(e.roc_auc - r.roc_auc, 4) AS delta_roc_auc, round(e.pr_auc - r.pr_auc, 4) AS delta_pr_auc, round(e.f1 - r.f1, 4) AS delta_f1,
       r.roc_auc AS raw_features_roc_auc, r.pr_auc AS raw_features_pr_auc, r.f1 AS raw_features_f1,
       e.roc_auc AS enhanced_features_roc_auc, e.pr_auc AS enhanced_features_pr_auc, e.f1 AS enhanced_features_f1
FROM r, e""")
def q_closed_form_delta(spark, sf_dir):
    _, test = _split(spark, sf_dir)
    both = test.select("machine_failure", (F.col("torque_nm") / 100.0).alias("score"), F.lit("raw_features").alias("feature_set")).unionByName(
        test.select("machine_failure", F.col("risk").alias("score"), F.lit("enhanced_features").alias("feature_set")))
    m = metrics.model_metrics(both, "machine_failure", "score", by=["feature_set"])
    return W.metric_delta(m.select("feature_set", "roc_auc", "pr_auc", "f1"))


# --- M6, M5 ----------------------------------------------------------------------------------------

@register("prior_baseline", ids="M6 A6 A7", oracle=with_(READINGS, SPLIT_SQL) + f"""
, p AS (SELECT avg(machine_failure::DOUBLE) AS p FROM split WHERE is_test = 0),
rs AS (SELECT 1 AS g, p AS score, machine_failure AS y FROM split, p WHERE is_test = 1),
{auc_ap_sql("rs", "g")}
SELECT (SELECT round(p, 6) FROM p) AS prior, round(roc_auc, 4) AS roc_auc, round(average_precision, 4) AS pr_auc FROM auc""")
def q_prior_baseline(spark, sf_dir):
    """The training rows' class prior as every holdout row's score."""
    train, test = _split(spark, sf_dir)
    scored = P.prior_scores(train, test)
    m = metrics.ranking_metrics(scored, "machine_failure", "score")
    prior = scored.agg(F.round(F.first("score"), 6).alias("prior"))
    return prior.crossJoin(F.broadcast(m.select(round4("roc_auc").alias("roc_auc"), round4("average_precision").alias("pr_auc"))))  # one row each


_HOLES = "CASE WHEN product_id % 50 = 0 THEN NULL ELSE {} END"


def _standard(f: str) -> str:
    return f"round((coalesce({f}, m_{f}) - a_{f}) / s_{f}, 6) AS {f}"


@register("preprocessed", ids="M5", oracle=with_(READINGS, SPLIT_SQL) + f"""
, holed AS (SELECT product_id, is_test, machine_type, {', '.join(f"{_HOLES.format(f)} AS {f}" for f in NUMERIC_FEATURES)} FROM split),
med AS (SELECT {', '.join(f'quantile_cont({f}, 0.5) AS m_{f}' for f in NUMERIC_FEATURES)} FROM holed WHERE is_test = 0),
st AS (SELECT {', '.join(f'avg(coalesce({f}, m_{f})) AS a_{f}, stddev_samp(coalesce({f}, m_{f})) AS s_{f}' for f in NUMERIC_FEATURES)} FROM holed, med WHERE is_test = 0)
SELECT product_id, {', '.join(_standard(f) for f in NUMERIC_FEATURES)}, CAST(machine_type = 'click' AS INTEGER) AS machine_type_click, CAST(machine_type = 'error' AS INTEGER) AS machine_type_error,
       CAST(machine_type = 'purchase' AS INTEGER) AS machine_type_purchase, CAST(machine_type = 'signup' AS INTEGER) AS machine_type_signup, CAST(machine_type = 'view' AS INTEGER) AS machine_type_view
FROM holed, med, st WHERE is_test = 1""")
def q_preprocessed(spark, sf_dir):
    """Imputed, standardised and one-hot encoded holdout rows; every fiftieth row has lost its numbers."""
    holes = {f: F.when(F.col("product_id") % 50 != 0, F.col(f)) for f in NUMERIC_FEATURES}
    s = stage(stratified_split(_rows(spark, sf_dir)).withColumns(holes), "split")
    out = P.preprocess(s.where("is_test = 0"), s.where("is_test = 1"), NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    encoded = [c for c in out.columns if any(c.startswith(f"{k}_") for k in CATEGORICAL_FEATURES)]
    return out.select("product_id", *[F.round(f, 6).alias(f) for f in NUMERIC_FEATURES], *encoded)


# --- M13 -------------------------------------------------------------------------------------------

_MODES = " UNION ALL ".join(f"SELECT '{code}' AS failure_code, product_id, {code.lower()} AS y, risk AS score FROM split WHERE is_test = 1" for code in C.FAILURE_CODES)
_LABELS = "CASE failure_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FAILURE_LABELS.items()) + " END"


@register("closed_form_modes", ids="M13 A5 A6 A7 W5", oracle=with_(READINGS, SPLIT_SQL) + f"""
, rs AS ({_MODES}),
learnt AS (SELECT unnest([{', '.join(f"{{'c': '{c}', 'n': (SELECT CAST(sum({c.lower()}) AS BIGINT) FROM split WHERE is_test = 0)}}" for c in C.FAILURE_CODES)}], recursive := true)),
{auc_ap_sql("rs", "failure_code")},
cell AS (
    SELECT failure_code, sum(y) AS p, sum(CASE WHEN score >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN score < 0.5 THEN y ELSE 0 END) AS fn
    FROM rs GROUP BY 1),
ranked_m AS (SELECT *, row_number() OVER (PARTITION BY failure_code ORDER BY score DESC, product_id) AS rk, greatest(1, ceil(count(*) OVER (PARTITION BY failure_code) * {C.PRIMARY_REVIEW_FRACTION!r}::DOUBLE)) AS n FROM rs),
cap AS (SELECT failure_code, sum(CASE WHEN rk <= n THEN y ELSE 0 END) AS cap FROM ranked_m GROUP BY 1)
SELECT failure_code, {_LABELS} AS label, l.n AS train_failures, CAST(p AS BIGINT) AS holdout_failures, round(roc_auc, 4) AS roc_auc, round(average_precision, 4) AS pr_auc,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision, round(CASE WHEN p > 0 THEN tp / p ELSE 0.0 END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
       round(CASE WHEN p > 0 THEN cap / p ELSE 0.0 END, 4) AS capture_rate_at_10pct_budget
FROM cell JOIN auc USING (failure_code) JOIN cap USING (failure_code) JOIN learnt l ON l.c = failure_code""")
def q_closed_form_modes(spark, sf_dir):
    """Per failure mode the metrics and the capture of its own queue, every mode scored by the closed form."""
    train, test = _split(spark, sf_dir)
    pos = train.agg(*[F.sum(c.lower()).cast("bigint").alias(c) for c in C.FAILURE_CODES]).first()
    parts = [test.select("product_id", F.col(c.lower()).alias("y"), F.col("risk").alias("score"), F.lit(c).alias("failure_code"), F.lit(pos[c]).cast("bigint").alias("train_failures"))
             for c in C.FAILURE_CODES]
    return W.mode_report(reduce(lambda a, b: a.unionByName(b), parts))
