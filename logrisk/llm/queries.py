"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrisk.llm import (
    blocks, exactdup, lexical, lines, minhash, mixing, negatives, pieces, secrets, topk, toxicity, urls, vectors, warc,
)
from logrisk.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

#: Fixed values of the task: rules by host and path.
RULES = [
    urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"),
]


def query(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


def model_file() -> str:
    """The piece vocabulary: LOGRISK_PIECES, or that of the public tokenizers."""
    named = os.environ.get("LOGRISK_PIECES")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_exact_hash(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.dedup(table(spark, folder, "documents"))


@query
def op3_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_digests(pieces.round_trip(table(spark, folder, "documents"), model_file()))


def piece_digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_mix_pivotal(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op7_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_linked")


@query
def op9_line_edits(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))


@query
def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op8_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), RULES)


def _shifted(rows: DataFrame) -> DataFrame:
    """The labels of every seventh vector moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", label)


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks.integer_vectors(_shifted(table(spark, folder, "embeddings")))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query
def op12_mask_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_term_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks.integer_vectors(table(spark, folder, "embeddings").drop("label"))
    return topk.search(rows, F.col("vec_id") % 50 == 0)
