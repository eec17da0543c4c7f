"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wearline.llm import (
    conversations,
    edit_fingerprint,
    hmm,
    lattice,
    merkle,
    minhash,
    mixing,
    oracles,
    prefix_free,
    privacy,
    quality,
    suffix_trees,
    toxicity,
)
from wearline.llm import sentencepiece_backend as pieces
from wearline.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@register
def op10_sentencepiece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.read_model(pieces.MODEL), with_ids=False)


@register
def op1_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


@register
def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE["op5_sainte_lague_mix"] = mixing.ORACLE


@register
def op7_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(privacy.detect(table(spark, sf_dir, "documents")))


@register
def op3_edit_embedding_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edits(table(spark, sf_dir, "documents"))


@register
def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


@register
def op8_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.dedup_windows(table(spark, sf_dir, "documents"))


@register
def op6_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.dedup_bytes(table(spark, sf_dir, "documents"))


@register
def op2_lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_classes(table(spark, sf_dir, "embeddings"))


@register
def op11_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op12_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@register
def op13_prefix_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(conversations.rebuild(table(spark, sf_dir, "conversations")))


ORACLE |= {"op12_postorder_manifest": oracles.OP12, "op13_prefix_collapse": oracles.OP13}
ORACLE |= {"op2_lattice_neighbours": oracles.OP2, "op4_circulant_minhash": oracles.OP4, "op6_prefix_free_parse": oracles.OP6, "op8_prefix_suffix_trees": oracles.OP8}
