"""Documents to packed training sequences, stage by stage.

Each stage works on what the one before kept, has one of the package's operators decide, and
returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chunking, lines, packing, quality, simhash
from barloom.llm.common import table
from barloom.llm.queries import tokenizer
from barloom.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.filter_documents(docs, "v1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of two lines or more that an earlier document or place has; documents that lose everything go."""
    return _with_words(lines.without_passages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity of 0.8 or more over 5-word shingles."""
    return simhash.keep_one(docs, simhash.similar_groups(docs, ngram=5, similarity=0.8))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the substrings that an earlier document or place has; documents that lose everything go."""
    return _with_words(chunking.without_passages(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packed),
]

# Rolling hashes, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
