"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import (
    bytepair, decontamination, divergence, language_model, lines, packing, phrases, pii, secrets, simhash, topk, toxicity, vectors,
)
from tallyshelf.llm.oracle import ORACLE

# Places of the public vocabularies; parameters of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    pieces = packing.token_pieces(docs, BYTE_BPE_RANKS, public_tokenizers.PATTERN, BYTE_BPE, END_ID)
    return packing.pack(pieces)


def op2_kneser_ney_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(table(spark, folder, "documents"))


def op4_flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op5_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, folder, "documents")))


def op6_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return bytepair.round_trip(table(spark, folder, "documents"), BYTE_BPE_RANKS, public_tokenizers.PATTERN)


def op8_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_personal(table(spark, folder, "documents")))


def op9_kd_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(table(spark, folder, "embeddings")))


def op10_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lines.dedup_lines(docs)


def op11_prefix_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of all sources of ``documents``."""
    return divergence.audit(table(spark, folder, "documents"))


def op12_automaton_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    found = decontamination.find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontamination.digest(found).drop("spans")


def op13_graph_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of all languages of ``documents``."""
    return phrases.mine(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pattern_packing, op2_kneser_ney_toxicity, op3_backoff_automaton, op4_flat_graph, op5_trigram_secrets, op6_simhash_trie, op7_byte_pairs,
        op8_boosted_pii, op9_kd_top_k, op10_fuzzy_lines, op11_prefix_divergence, op12_automaton_decontamination, op13_graph_phrases,
    )
}
