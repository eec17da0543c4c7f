"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokenisation.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. ``run`` applies them to ``documents``.

* quality: documents that the discriminant gives a posterior below 0.5 of being good go;
* minhash: of each class of near-duplicates (five-word shingles, Jaccard 0.8 or more) the smallest id stays,
  of rows equal in id and text one;
* pii: base spans become [KIND], telling terms are removed or generalised, n_chars follows;
* mix: every document appears as often as the mix takes it, to the nearest whole number;
* sentencepiece: one row of token digests per document of the mix.

Nulls, empty tables and extra columns behave as the operators' docstrings say; extra columns stay until the last
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import minhash, mixing, privacy, quality
from wearline.llm import sentencepiece_backend as pieces
from wearline.llm.common import stage
from wearline.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject_junk(docs, table(spark, sf_dir, "labels"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, width=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return privacy.sanitise(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.read_model(pieces.MODEL), with_ids=False)


STAGES = [("quality", quality_stage), ("minhash", minhash_stage), ("pii", pii_stage), ("mix", mix_stage), ("sentencepiece", sentencepiece_stage)]

#: trained models, hashing and a tokenizer are beyond SQL; the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
