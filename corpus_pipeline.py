"""Pipeline from documents to token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the documents of the next one:

1. toxicity: documents the network scores at 0.5 or more go;
2. line dedup: lines that an earlier document has, exactly or but for an edit
   in 40 characters, are taken out; a document of which nothing is left goes;
3. near duplicates: one document of each group, linked at a similarity of 0.8 or more, stays;
4. mixing: documents are left out, kept or repeated to reach the targets;
5. pieces: token ids and decoded text of each document, as counts and digests.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from logrisk.llm import lines, minhash, mixing, pieces, queries, toxicity
from logrisk.llm.common import forget, step, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, all columns.

    Null and empty texts are scored as one empty window. Repeated rows are
    scored alike, so all go or all stay. An empty table, or labels of one kind
    only, drop nothing.
    """
    with step(spark, "pipeline"):
        return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier one has, all columns.

    Null and empty texts stay; a text made of repeated lines alone goes. Rows
    that repeat id and text are one document and keep their lines. Null ids
    come last. An empty table gives no rows.
    """
    with step(spark, "pipeline"):
        return lines.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, all columns: that of the smallest id (null last), then hash of the text.

    Of rows that repeat both, one stays. Texts without words, null ones too,
    are in no group and stay. An empty table gives no rows.
    """
    with step(spark, "pipeline"):
        return minhash.one_of_each(docs, (100, 80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left out, kept or repeated to reach the targets, all columns.

    A null source is a source of its own. Null and blank texts count no words
    and are rounded each on their own, and so is each of repeated rows. An
    empty table gives no rows.
    """
    with step(spark, "pipeline"):
        return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests: doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row.

    A document that the mix repeats is encoded for each of its rows. Null and
    empty texts have no tokens. An empty table gives no rows.
    """
    with step(spark, "pipeline"):
        return queries.piece_digests(pieces.round_trip(docs, queries.model_file()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: A network, edit distances and hashes of random choices are no SQL; tests use plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; tables of a stage are deleted when no later one reads them.

    Only one run at a time in an application. Without documents there are no rows.
    """
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    with step(spark, "pipeline"):
        return docs
