"""The corpus pipeline: toxic documents go, repeated lines and near-duplicates go, personal data is masked, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyshelf.llm import lines, packing, pii, simhash, toxicity
from tallyshelf.llm.queries import BYTE_BPE, BYTE_BPE_RANKS, END_ID, table
from tallyshelf.sources.scratch import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; labels come from the table ``labels``. All columns stay."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line left of each group of similar ones; no document goes, an emptied text stays empty."""
    return lines.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id. All columns stay."""
    return simhash.keep_one(docs)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced in their texts. All rows and columns stay."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place in it; every document is packed."""
    return packing.pack(packing.token_pieces(docs, BYTE_BPE_RANKS, public_tokenizers.PATTERN, BYTE_BPE, END_ID))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("PII", personal_stage),
    ("best-fit packing", packing_stage),
]
# Fitted models, MinHash, tries and tokenizers cannot be written in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each writes what it keeps and the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
