"""Queries of the corpus operators over the driver's tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import (html_text, language_id, merkle, mixing, neighbours, packing, pieces, quality_rules, simhash, substring, token_counts, token_files,
                         vector_codes)
from airgrid.llm.common import table, vocabulary
from airgrid.session import shared_folder


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language, posterior and verdict of every document, with the evidence of the pages that show them."""
    found = language_id.identify_documents(table(spark, folder, "documents"), table(spark, folder, "pages"), F.col("doc_id"))
    return found.withColumnRenamed("key", "doc_id")


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base_failed and kept of every document."""
    return quality_rules.quality_columns(table(spark, folder, "documents"), keep=["doc_id"])


def op3_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    cut = packing.cut(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 2048)
    return packing.pack(cut, 2048)


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words, removed words and digest of the words left, of every document."""
    return substring.remove_repeats(table(spark, folder, "documents"), digest=True)


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Starts, counts and checksums of all documents' ids, read back from ORC files."""
    path = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    token_files.write_ids(table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"))
    files = token_files.read_ids(spark, path)
    return token_files.with_starts(token_files.checksums(files), files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all vectors."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return pieces.encode_and_decode(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), digests=True)


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, folder, "pages"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and root of every document, and what a tampered text folds to."""
    docs = table(spark, folder, "documents")
    leaves = merkle.leaves_of(docs, tampered=merkle.tampered_fifth(F.col("doc_id")))
    return merkle.manifest(leaves).withColumnRenamed("key", "doc_id")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors, their errors and the digest of the codebooks."""
    return vector_codes.codes(table(spark, folder, "embeddings"))


def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.shares(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_simhash_near_duplicates, op4_pattern_packing, op5_substring_dedup, op6_token_files, op7_nearest_neighbours, op8_sentencepiece, op9_html_text, op10_token_counts,
                                   op11_merkle_manifest, op12_vector_codes, op13_source_mix)}
ORACLES = {"op2_quality_rules": quality_rules.oracle(), "op13_source_mix": mixing.oracle()}
