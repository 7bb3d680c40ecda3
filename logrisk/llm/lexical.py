"""Ranked lexical search by groups of documents that match the same terms.

Documents are tokenised once; what the terms of the items occur in is written
as a table (document, its number of terms, terms, occurrences), from which the
counts of the corpus come. Then blocks of documents meet the items. For an
item, every document has a mask, one bit for each term of the item, set by
or-ing the presence of the terms. Equal masks are one group. The sum of the
greatest contributions of the terms in a mask is the most that a document of
the group can score. Groups are evaluated by falling maximum, some at once,
until the next maximum is below the lowest of the k best found so far: no
document left can be among the first k. Best rows live on from block to block
of a task, so later blocks stop sooner.

Items are taken in portions of bounded size; a portion is sent to every task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrisk.llm import blocks
from logrisk.llm.common import stored

#: Maximal runs of these are terms.
TERM = "[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of the items of one portion; an item is never cut.
PORTION = 2_000_000
#: Documents of one block.
BLOCK = 4096
#: Documents of the masks that are evaluated together.
TOGETHER = 64
#: Share of length in the weight of an occurrence, in per cent.
LENGTH_SHARE = 75

_term = re.compile(TERM)
_lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

OCCURRENCES = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item long, doc_id long, score long"


def terms(text: str | None) -> list[str]:
    """The terms of a text in order; only A-Z are lower-cased."""
    return [t.translate(_lower) for t in _term.findall(text)] if text else []


@dataclass
class Portion:
    """Some items: (place in `named`, terms with their repeats), and the terms by number."""

    named: list
    wanted: list[Counter]
    numbers: dict[str, int]

    @classmethod
    def of(cls, items: list) -> Portion:
        wanted = [Counter(terms(text)) for _, text in items]
        numbers: dict[str, int] = {}
        for w in wanted:
            for t in w:
                numbers.setdefault(t, len(numbers))
        return cls([i for i, _ in items], wanted, numbers)


def _portions(items: DataFrame) -> Iterator[Portion]:
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row[1] or "") > PORTION:
            yield Portion.of(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1] or "")
    if held:
        yield Portion.of(held)


def _occurrences(numbers):
    """Of each document the number of its terms, and those of the portion with their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, which, tfs = [], [], []
                for text in part.column(1).to_pylist():
                    counts: Counter = Counter()
                    total = 0
                    for t, c in Counter(_term.findall(text or "")).items():
                        total += c
                        k = known.get(t.translate(_lower))
                        if k is not None:
                            counts[k] += c
                    n.append(total)
                    which.append(list(counts))
                    tfs.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                    ["doc_id", "n", "terms", "tfs"])
    return run


# ------------------------------------------------------------------ masks

class _Block:
    """Documents with the impact of every occurrence, by document and by term."""

    def __init__(self, doc_id: list, n: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 documents: int, total: int, vocabulary: int):
        order = sorted(range(len(doc_id)), key=lambda i: (doc_id[i] is None, doc_id[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.doc_id = [doc_id[i] for i in order]
        m = 100 - LENGTH_SHARE + np.array([LENGTH_SHARE * x * documents // total for x in n[order].tolist()], np.int64)
        doc = np.repeat(place, lengths)
        by_doc = np.argsort(doc, kind="stable")
        self.doc, self.term = doc[by_doc], term[by_doc]
        self.impact = 1_000_000_000 * tf[by_doc] // (1000 * tf[by_doc] + 8 * m[self.doc])
        self.starts = np.searchsorted(self.doc, np.arange(len(order) + 1))
        # The documents of a term, and the greatest impact among them.
        by_term = np.argsort(self.term, kind="stable")
        self.docs_of_term = self.doc[by_term]
        self.term_starts = np.searchsorted(self.term[by_term], np.arange(vocabulary + 1))
        self.greatest = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.greatest, self.term, self.impact)

    def masks(self, wanted: np.ndarray) -> np.ndarray:
        """One row per document: bit b of word b // 64 tells whether it has term b of the item."""
        out = np.zeros((len(self.doc_id), -(-len(wanted) // 64)), np.uint64)
        for b, t in enumerate(wanted.tolist()):
            out[self.docs_of_term[self.term_starts[t]:self.term_starts[t + 1]], b >> 6] |= np.uint64(1 << (b & 63))
        return out

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores; weight holds what each term of the vocabulary counts for the item."""
        starts, sizes = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        sums = np.concatenate([[0], np.cumsum(weight[self.term[at]] * self.impact[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks, and the number of the mask of each document."""
    if masks.shape[1] == 1:
        distinct, of = np.unique(masks[:, 0], return_inverse=True)
        return distinct[:, None], of
    distinct, of = np.unique(masks, axis=0, return_inverse=True)
    return distinct, of.reshape(-1)


def maxima(distinct: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each mask the sum of the greatest contributions of its terms."""
    bits = np.unpackbits(distinct.view(np.uint8), axis=1, bitorder="little")[:, :len(most)]
    return (bits.astype(np.int64) * most).sum(axis=1)


class _Best:
    """The k best (score, doc_id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """Documents below this score can't come in."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, rows: list) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1]))[:self.k]


def _evaluate(block: _Block, wanted: np.ndarray, weights: np.ndarray, best: _Best, room: np.ndarray) -> int:
    """Groups of the block by falling maximum until no more can count; the number of documents scored."""
    distinct, of = groups(block.masks(wanted))
    most = maxima(distinct, weights * block.greatest[wanted])
    order = np.argsort(-most, kind="stable")
    members = np.argsort(of, kind="stable")
    first = np.searchsorted(of[members], np.arange(len(distinct) + 1))
    sizes = np.diff(first)[order]
    room[wanted] = weights
    at = scored = 0
    while at < len(order) and most[order[at]] >= best.least():
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:at + TOGETHER]), TOGETHER)))
        some = [g for g in order[at:stop] if most[g] >= best.least()]
        docs = np.concatenate([members[first[g]:first[g + 1]] for g in some])
        scores = block.scores(docs, room)
        keep = np.flatnonzero(scores >= best.least())
        # No more than k of these can stay; equal scores go by place, which is the order of ids.
        keep = keep[np.lexsort((docs[keep], -scores[keep]))[:best.k]]
        best.add([(int(scores[i]), block.doc_id[docs[i]]) for i in keep])
        at, scored = stop, scored + len(docs)
    room[wanted] = 0
    return scored


def _ranked(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, documents, total, vocabulary = shared.value
        best = [_Best(k) for _ in asked]
        room = np.zeros(vocabulary, np.int64)
        for block in _blocks(batches, documents, total, vocabulary):
            for b, (wanted, weights) in zip(best, asked):
                _evaluate(block, wanted, weights, b, room)
        rows = [(i, doc, score) for i, b in enumerate(best) for score, doc in b.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch], documents: int, total: int, vocabulary: int) -> Iterator[_Block]:
    held: list[pa.RecordBatch] = []

    def made() -> _Block:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t["terms"].combine_chunks()
        return _Block(t["doc_id"].to_pylist(), t["n"].to_numpy(), np.diff(lists.offsets.to_numpy()),
                      lists.flatten().to_numpy(), t["tfs"].combine_chunks().flatten().to_numpy(), documents, total, vocabulary)

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(start, BLOCK))
            if sum(b.num_rows for b in held) >= BLOCK:
                yield made()
                held = []
    if held:
        yield made()


# ------------------------------------------------------------------ the search

def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item.

    docs: doc_id, text. items: item_id, text. Further columns are not read. The
    score sums w * ((10 ** 9 * tf) div (1000 * tf + 8 * m)) over the terms of
    the item, repeats included, with w = floor(1000 * ln((2N + 2) / (2df + 1)))
    and m = 25 + (75 * n * N) div L; N and L count documents with a term and
    all their terms, n the terms of a document, df the documents with a term.
    Documents with score 0 are left out. Equal scores go by doc_id, null last.
    Null and empty texts have no terms. Every row of docs is a document of its
    own, also where rows or ids repeat. Items that repeat in id and text count
    once; of items with one id and different texts each has its list. Without
    items or documents with terms there are no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    items = stored(items.distinct().sort("item_id", "text"), "lexical-items")
    out = spark.createDataFrame([], docs.limit(0).select(
        F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("score")).schema)
    for portion in _portions(items):
        out = out.unionByName(_of_portion(docs, portion, k, kind))
    return out


def _of_portion(docs: DataFrame, portion: Portion, k: int, kind) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    found = stored(docs.mapInArrow(_occurrences(context.broadcast(portion.numbers)), OCCURRENCES), "lexical-occurrences")
    documents, total = found.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    # As many rows as the portion has terms.
    df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = [_weight(documents or 0, df.get(t, 0)) for t in range(len(portion.numbers))]
    asked = []
    for counts in portion.wanted:
        numbers = [portion.numbers[t] for t in counts]
        asked.append((np.array(numbers, np.int64), np.array([c * weight[t] for t, c in zip(numbers, counts.values())], np.int64)))
    shared = context.broadcast((asked, documents or 0, total or 1, len(portion.numbers)))
    best = found.where(F.size("terms") > 0).mapInArrow(_ranked(shared, k), FOUND)
    best = blocks.first_rows(best, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    names = spark.createDataFrame(list(enumerate(portion.named)), f"item long, item_id {kind.simpleString()}")
    return best.join(F.broadcast(names), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
