"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass over the texts gives each document ``D`` transformed statistics. Statistics of a short text say
little, so each is drawn towards the training rows' mean by the weight words / (words + ``FULL``). The class
means and covariances come from one aggregate of first and second moments over all labelled training
rows (no sample). Each covariance is shrunk towards the pooled one and towards a multiple of
the identity; its Cholesky factor is computed once and travels with the scoring function, which
needs only a triangular solve for each block of rows.

Defined results: null text counts as empty; empty texts get statistics and a score too; a class
without training rows leaves every score at the other class's label (0.5 without any label); null
labels and labels other than 0 and 1 are ignored; repeated label rows of one id agree on the
smallest; other columns of the input are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, stage, text_column, texts

STATISTICS = ("bytes", "words", "word_length", "longest_word", "upper", "digits", "stops", "symbols", "marks", "bars",
              "line_ends", "beyond_ascii", "distinct_words", "distinct_pairs", "same_next", "top_word", "deflated",
              "entropy", "distinct_lines", "capitals")
D = len(STATISTICS)
FULL = 40.0
#: bytes counted together, in the order of their statistics
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"#$%&*+/<=>@[\\]^_`{}~", b"!", b"|", b"\n\r"]


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one whole text."""
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    share = [hist[list(c)].sum() / max(n, 1) for c in _CLASSES]
    words = data.split()
    w = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    p = hist[hist > 0] / max(n, 1)
    lines = [x for x in data.split(b"\n") if x]
    rate = lambda x: float(np.log(x + 0.002))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(sum(map(len, words)) / w), np.log1p(max(map(len, words), default=0)),
        *(rate(x) for x in share), rate(hist[128:].sum() / max(n, 1)),
        np.log(max(len(counts), 1)) / np.log(w + 1), len(set(zip(words, words[1:], strict=False))) / w,
        rate(sum(map(bytes.__eq__, words, words[1:])) / w), rate(max(counts.values(), default=0) / w),
        np.log((len(zlib.compress(data, 1)) + 20) / (n + 20)), float(-(p * np.log2(p)).sum()),
        len(set(lines)) / max(len(lines), 1), rate(len(re.findall(rb"(?:^|\s)[A-Z]", data)) / w),
    ]


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, x array<double>)`` for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batch: pa.RecordBatch) -> dict:
        x = np.array([statistics(t) for t in texts(batch)], np.float64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * D), pa.array(x.ravel()))
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "x": flat}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"),
                       text_column(docs, text_col).alias("text"))
    return arrow_map(rows, of, f"doc_id {kind}, text_hash bigint, x array<double>")


def weights(x: np.ndarray) -> np.ndarray:
    """How much the statistics of each row count, by its number of words."""
    words = np.expm1(x[:, 1:2])
    return words / (words + FULL)


def moments(rows: DataFrame, center: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class 0 and 1: count, mean and covariance of the statistics drawn towards ``center``; one
    partial-and-final aggregate whose result is two rows of fixed width."""
    weight = F.expm1(F.col("x")[1]) / (F.expm1(F.col("x")[1]) + FULL)
    drawn = [(F.lit(float(center[i])) + (F.col("x")[i] - F.lit(float(center[i]))) * weight).alias(f"z{i}") for i in range(D)]
    at = [F.col(f"z{i}") for i in range(D)]
    sums = [F.sum(at[i]) for i in range(D)] + [F.sum(at[i] * at[j]) for i in range(D) for j in range(i, D)]
    got = rows.where("label in (0, 1)").select("label", *drawn).groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()
    out = {}
    for r in got:
        s, n = np.array(r.s), r.n
        mean, second = s[:D] / n, np.zeros((D, D))
        second[np.triu_indices(D)] = s[D:] / n
        second = second + np.triu(second, 1).T
        out[int(r.label)] = (n, mean, second - np.outer(mean, mean))
    return out


class Discriminant:
    """Two Gaussians with shrunken covariances; ``score`` is the posterior of class 1."""

    def __init__(self, parts: dict, pooled: float = 0.15, ridge: float = 0.02, center: np.ndarray | None = None):
        self.center = center
        self.only = None if len(parts) == 2 else (float(next(iter(parts))) if parts else 0.5)
        if self.only is not None:
            return
        total = sum(p[0] for p in parts.values())
        shared = sum(p[0] / total * p[2] for p in parts.values())
        self.scale = np.sqrt(np.maximum(np.diag(shared), 1e-9))
        self.parts = []
        for c in (0, 1):
            n, mean, cov = parts[c]
            cov = ((1 - pooled) * cov + pooled * shared) / np.outer(self.scale, self.scale)
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / D, 1e-6) * np.eye(D)
            chol = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(chol).T, np.log(n / total) - np.log(np.diag(chol)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        if self.center is not None:
            x = self.center + (x - self.center) * weights(x)
        logs = [const - 0.5 * ((((x - mean) / self.scale) @ solve) ** 2).sum(1) for mean, solve, const in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, target: str = "quality", held_out: int = 2, folds: int = 4) -> Discriminant:
    """Learn from every labelled row whose crc32(doc_id as text) mod ``folds`` is not ``held_out``."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(target).alias("label"))
    train = features.where(~fold_is("doc_id", held_out, folds)).join(known, "doc_id").select("x", "label")
    center = train.where("label in (0, 1)").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(D)])).first()[0]
    center = np.array([v or 0.0 for v in center])  # of no rows: nulls
    return Discriminant(moments(train, center), center=center)


def fold_is(column: str, held_out: int, folds: int):
    """crc32(column as text) mod folds = held_out; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == held_out, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, text_hash, held_out, score, predicted``."""
    rows = stage(featurize(docs), "quality")
    model = fit(rows, labels)

    def of(batch: pa.RecordBatch) -> dict:
        x = np.asarray(batch.column("x").flatten()).reshape(-1, D)
        return {n: batch.column(n) for n in batch.schema.names if n != "x"} | {"score": model.score(x)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = arrow_map(rows.withColumn("held_out", fold_is("doc_id", 2, 4)), of,
                    f"doc_id {kind}, text_hash bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_junk(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; columns as they were."""
    bad = score(docs, labels, threshold).where("predicted = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_id")) & (key == F.col("_h")), "left_anti")
