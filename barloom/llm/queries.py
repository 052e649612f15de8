"""Registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chunking, embeddings, langid, lines, packing, ppm, prefixtrie, quality, simhash, tokencount, tokenfile
from .common import table


def tokenizer(name: str) -> str:
    """A public tokenizer's file, at the same place on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold substrings which an earlier document, or place, has: what stays of them, what goes, whose it was."""
    return chunking.passages(table(spark, sf_dir, "documents"))


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; a seventh of the ids is held out from training."""
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    scored = ppm.stream_scores(table(spark, sf_dir, "documents"), training)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages of two lines or more which an earlier document, or place, has: what stays of them, what goes, whose it was."""
    return lines.passages(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files and reads every document back from them."""
    index = tokenfile.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return tokenfile.read(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 3-word shingles, at most 3 bits apart."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), ngram=3, radius=3)
    return groups.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector: equal labels, cosine of 0.98 or more."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokencount.count(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per document with the verdicts of the policies "base" and "v1"."""
    led = quality.ledger(table(spark, sf_dir, "documents"))
    failed = ~quality.keeps(F.col("fail_bits"), "base")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
                      failed.alias("base_failed"), (~failed & quality.keeps(F.col("fail_bits"), "v1")).alias("kept"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    ranks, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third of the ids is held out from learning."""
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1
    found = langid.identify(table(spark, sf_dir, "documents"), training)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "lang_pred", "score")


def own_after() -> Column:
    """How many first turns a conversation takes from its group's first one."""
    return (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")


def shared_base() -> Column:
    """The first conversation of a group of twenty."""
    return F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(20))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    return prefixtrie.trie(table(spark, sf_dir, "conversations"), own_after(), shared_base())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every document, and how common its links are."""
    return alignment.cross_align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_ppm_scores, op4_line_dedup, op5_token_files, op6_simhash,
                                   op7_near_embeddings, op8_token_counts, op9_quality_rules, op10_byte_bpe, op11_language_id, op12_prefix_trie,
                                   op13_token_alignment)}
