"""Hard negatives by a secondary sort.

The scores of an anchor with other rows are packed into keys (anchor, falling
score, kind, id), partitioned by anchor and sorted by the whole key in one
shuffle. A task then reads its pairs as a stream. A positive opens a window of
scores below its own; a negative goes to each open window that it lies in and
that is not full. Only the few windows of the current anchor are held, never
its pairs. At equal scores positives come first, so a window is open before
the first negative that can fall into it.

Blocks of rows send only pairs that can count: the first positives of the
block, and, once the positives of an anchor are known, the first negatives of
the block in each of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.llm import blocks
from logrisk.llm.common import stored
from logrisk.llm.topk import selected

#: Pairs of a partition of the secondary sort.
PAIRS = 500_000
#: Anchors whose scores are held together.
TOGETHER = 64
PAIR = ["anchor_id", "anchor_fp", "score", "vec_id"]
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def bounds(score: int, window: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest score s with low * score <= 100 * s <= high * score; none for scores below 0."""
    low, high = window
    return (-(-low * score // 100), high * score // 100) if score >= 0 else (1, 0)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whole inner products; in floating point only where it is exact."""
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (left, right)]
    if most[0] * most[1] * left.shape[1] < 2.0 ** 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def _scored(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor: its place, all scores, and the places of rows of its label and of other labels."""
    width = blocks.widest(rows["v"], anchors["v"])
    theirs, own = blocks.matrix(rows["v"], width), blocks.matrix(anchors["v"], width)
    number: dict = {}
    codes = np.array([number.setdefault(x, len(number)) for x in rows["label"].to_pylist()], np.int64)
    ids, labels = anchors["vec_id"].to_pylist(), anchors["label"].to_pylist()
    for start in range(0, len(ids), TOGETHER):
        for k, scores in enumerate(products(own[start:start + TOGETHER], theirs), start):
            other, same = blocks.others(rows, ids[k]), codes == number.get(labels[k], -1)
            yield k, scores, np.flatnonzero(other & same), np.flatnonzero(other & ~same)


def _pairs(rows: pa.Table, anchors: pa.Table, of: list, places: list, scores: list) -> pa.Table:
    counts = list(map(len, places))
    at = pa.array(np.repeat(np.array(of, np.int64), counts))
    places, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, scores))
    columns = [anchors["vec_id"].take(at), anchors["fp"].take(at), pa.array(scores), rows["vec_id"].take(pa.array(places))]
    return pa.table(columns, names=PAIR)


def _positives(most: int):
    """The first rows of an anchor's label in a block."""
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, of, places, found = blocks.by_id(rows), [], [], []
        for k, scores, same, _ in _scored(rows, anchors):
            best = same[selected(scores[same], most)]
            of.append(k)
            places.append(best)
            found.append(scores[best])
        return _pairs(rows, anchors, of, places, found)
    return work


def _negatives(most: int, window: tuple[int, int]):
    """The first rows of other labels in each window of an anchor in a block, each once."""
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, of, places, found = blocks.by_id(rows), [], [], []
        opened = anchors["positives"].to_pylist()
        for k, scores, _, other in _scored(rows, anchors):
            falling = ~scores[other]
            order = np.argsort(falling, kind="stable")
            falling, taken = falling[order], set()
            for score in set(opened[k]):
                low, high = bounds(score, window)
                first = int(np.searchsorted(falling, ~high))
                taken.update(range(first, min(first + most, int(np.searchsorted(falling, ~low, "right")))))
            best = other[order[sorted(taken)]] if taken else np.zeros(0, np.int64)
            of.append(k)
            places.append(best)
            found.append(scores[best])
        return _pairs(rows, anchors, of, places, found)
    return work


def _key(kind: int, row) -> tuple:
    """((anchor, falling score, kind, id), nothing); missing ids come last."""
    return (row[0], row[1], -row[2], kind, row[3] is None, row[3]), None


def _partition(key: tuple) -> int:
    return hash((key[0], key[1]))


def mined(pairs: Iterator[tuple], most: int, window: tuple[int, int]) -> Iterator[tuple]:
    """Rows of MINED from sorted pairs of any number of anchors."""
    anchor, opened = None, []
    for (anchor_id, fp, falling, kind, _, vec_id), _ in pairs:
        if anchor != (anchor_id, fp):
            anchor, opened = (anchor_id, fp), []
        score = -falling
        if not kind:
            opened.append([vec_id, score, *bounds(score, window), 0])
            continue
        for w in opened:
            if w[4] < most and w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor_id, w[0], w[4], vec_id, w[1], score


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3,
         window: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, fp, v as of `blocks.integer_vectors`; rows without a
    label take no part. anchors tells which rows are anchors. The positives of
    an anchor are the first `positives` other rows of its label, by falling
    score, then vec_id (null last). For each, the first `negatives` rows of
    other labels follow whose score lies in the window, in per cent of the
    positive's score; a negative score has an empty window. Rows of the anchor's
    own id are never its partners. Of rows with one id but different vectors or
    labels each is a row and an anchor of its own. Repeated rows are one row.
    Components that one vector lacks count as zero; sums beyond 64 bits wrap.
    No anchors, or anchors without partners, give no rows.
    """
    if not 0 <= window[0] <= window[1] <= 100:
        raise ValueError("a window lies between 0 and 100 per cent")
    spark = vectors.sparkSession
    rows = vectors.where("label is not null").select("vec_id", "fp", "label", "v")
    asked = rows.where(anchors)
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    found = blocks.in_blocks(rows, asked, _positives(positives), PAIR)
    first = stored(blocks.first_rows(found, ["anchor_id", "anchor_fp"], order, positives).drop("rank"), "negatives-positives")

    windows = first.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_fp").alias("fp")).agg(
        F.collect_list("score").alias("positives"))
    open_anchors = stored(asked.join(windows, ["vec_id", "fp"]), "negatives-anchors")
    near = stored(blocks.in_blocks(rows, open_anchors, _negatives(negatives, window), PAIR), "negatives-pairs")

    count = first.count() + near.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-count // PAIRS))
    keyed = first.rdd.map(partial(_key, 0)).union(near.rdd.map(partial(_key, 1)))
    sorted_pairs = keyed.repartitionAndSortWithinPartitions(parts, _partition)
    return spark.createDataFrame(sorted_pairs.mapPartitions(partial(mined, most=negatives, window=window)), MINED, verifySchema=False)
