"""Exact top-k by whole-number inner product, term at a time.

A component of a vector is a term with a weight. A block of rows becomes an
index: for each term the places of the rows that have it, with their weights.
Each query is the list of its terms. Term by term the weighted postings are
scattered into dense arrays of scores, one place per row of the block and one
array per query; nothing is skipped, so scores are exact. The k highest of a
block are found by partition selection, and the blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.llm import blocks

#: Queries whose arrays of scores are filled together.
TOGETHER = 64
SCORES = ["query_id", "query_fp", "vec_id", "score"]


def _postings(weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, places, weights) of the terms that some row has."""
    out = []
    for term, column in enumerate(weights.T):
        places = np.flatnonzero(column)
        if len(places):
            out.append((term, places, column[places]))
    return out


def accumulated(postings: list, queries: np.ndarray, rows: int) -> np.ndarray:
    """Dense scores (row, query): every posting of every term of every query, scattered."""
    scores = np.zeros((rows, len(queries)), np.int64)
    for term, places, weights in postings:
        having = np.flatnonzero(queries[:, term])
        if not len(having):
            continue
        added = np.multiply.outer(weights, queries[having, term])
        if len(having) == len(queries):
            scores[places] += added
        else:
            scores[np.ix_(places, having)] += added
    return scores


def selected(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first; of equal ones the earlier place."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    # The complement of a number falls where the number rises, without overflow.
    return places[np.argsort(~scores[places], kind="stable")[:k]]


def _searched(k: int):
    def work(rows: pa.Table, queries: pa.Table) -> pa.Table:
        width, rows = blocks.widest(rows["v"], queries["v"]), blocks.by_id(rows)
        postings = _postings(blocks.matrix(rows["v"], width))
        wanted = blocks.matrix(queries["v"], width)
        ids, fps = queries["vec_id"].to_pylist(), queries["fp"].to_pylist()
        of, places, found = [], [], []
        for start in range(0, len(ids), TOGETHER):
            scores = accumulated(postings, wanted[start:start + TOGETHER], rows.num_rows).T.copy()
            for q, row in enumerate(scores, start):
                own = np.flatnonzero(blocks.others(rows, ids[q]))
                best = own[selected(row[own], k)]
                of += [q] * len(best)
                places.append(best)
                found.append(row[best])
        places, found = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, found))
        return pa.table({
            "query_id": pa.array([ids[q] for q in of], pa.int64()), "query_fp": pa.array([fps[q] for q in of], pa.int64()),
            "vec_id": rows["vec_id"].take(pa.array(places)).combine_chunks().cast(pa.int64()), "score": pa.array(found)})
    return work


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest rows of each query.

    vectors: the rows of `blocks.integer_vectors`. queries tells which of them
    are queries; the candidates of a query are all rows of other ids (a null id
    differs from every other one, but not from itself). Equal scores go by
    smaller vec_id, null last. A component that one of two vectors lacks counts
    as zero. Of rows with one id but different vectors each is a row and a
    query of its own. Sums that leave 64 bits wrap around. No rows give no rows.
    """
    asked = vectors.where(queries).select("vec_id", "fp", "v")
    found = blocks.in_blocks(vectors.select("vec_id", "fp", "v"), asked, _searched(k), SCORES)
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    return blocks.first_rows(found, ["query_id", "query_fp"], order, k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
