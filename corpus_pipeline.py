"""Training-corpus pipeline: quality rules, near-duplicate removal, surrogates for personal data, packing.

Each stage works on all rows its predecessor kept; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import near_dup, packing, quality, surrogates
from loomdex.llm.common import materialize, read_table

#: Key of the surrogates; a deployment puts its own secret here.
SURROGATE_KEY = "corpus-key"
#: Words of a shingle and percent of similarity that make a near duplicate.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outlier of their language and source."""
    return quality.judge(docs, "text", "lang", "source").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that with the smallest id."""
    return near_dup.drop_duplicates(docs, "doc_id", "text", SHINGLE_WORDS, SIMILAR_PERCENT)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; the length follows the new text."""
    replaced = surrogates.replace(docs, "text", SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else replaced


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document's tokens in windows of several lengths."""
    pieces = packing.pack(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER), END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("private data", private_data),
    ("packing", pack),
]

#: SQL has no robust estimates and no tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
