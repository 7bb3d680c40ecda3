"""Searches and hard negatives against plain definitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrisk.llm import blocks, lexical, negatives, topk

VECTORS = "vec_id long, embedding array<double>, label int, v string, score string, rank string"


def vectors(seed, count, size=6, labels=3):
    """Rows with repeats, ties, nulls and lengths that differ."""
    r = random.Random(seed)
    rows = []
    for i in range(count):
        x = [round(r.uniform(-1, 1), 1 if i % 3 else 3) for _ in range(size)]
        if i % 4 == 1:
            x = rows[i - 1][1]
        if i % 17 == 5:
            x = x[:-2]
        rows.append((i, x, r.randrange(labels) if i % 11 else None))
    rows += [(count, None, 1), (count + 1, [1.0, float("nan")], 1), (count + 2, [None, 1.0], 2), (count + 3, [], 0),
             (count + 4, [float("inf")], 0), (None, [0.5] * size, 1), rows[7], rows[7]]
    return [(*row, "clash", "clash", "clash") for row in rows]


def whole(x):
    if x is None or any(c is None or not math.isfinite(c) for c in x):
        return None
    return [math.floor(256 * c) for c in x]


def taking_part(rows):
    """Different (vec_id, label, whole vector), smaller ids first, null last."""
    kept = {(i, label, tuple(whole(x))) for i, x, label, *_ in rows if whole(x) is not None}
    return sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def ranked(query, rows):
    """(score, id, row) by falling score, then id."""
    found = [(product(query[2], r[2]), r) for r in rows if r[0] != query[0]]
    return sorted(found, key=lambda f: (-f[0], f[1][0] is None, f[1][0] or 0))


@pytest.mark.parametrize("numbers", [1 << 19, 60])
def test_exact_search_equals_all_products(spark, monkeypatch, numbers):
    monkeypatch.setattr(blocks, "NUMBERS", numbers)
    rows = vectors(1, 120)
    frame = spark.createDataFrame(rows, VECTORS)
    whole_rows = blocks.integer_vectors(frame.drop("label"))
    got = topk.search(whole_rows, F.col("vec_id") % 5 == 0).collect()
    part = sorted({(r[0], None, r[2]) for r in taking_part(rows)}, key=lambda r: (r[0] is None, r[0] or 0))
    want = [(q[0], k, f[1][0], f[0]) for q in part if q[0] is not None and q[0] % 5 == 0
            for k, f in enumerate(ranked(q, part)[:5], 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_postings_scatter_only_shared_terms():
    rows, queries = np.array([[0, 2, 0], [1, 0, 0], [3, -1, 0]]), np.array([[0, 5, 7], [2, 0, 1]])
    index = topk._postings(rows)
    assert [(t, p.tolist(), w.tolist()) for t, p, w in index] == [(0, [1, 2], [1, 3]), (1, [0, 2], [2, -1])]
    assert topk.accumulated(index, queries, 3).tolist() == (rows @ queries.T).tolist()


def test_selection_breaks_ties_by_place():
    assert topk.selected(np.array([3, 5, 5, 1, 5, 3]), 4).tolist() == [1, 2, 4, 0]
    assert topk.selected(np.array([1, 2]), 5).tolist() == [1, 0]
    assert topk.selected(np.zeros(0, np.int64), 5).tolist() == []
    least = np.iinfo(np.int64).min
    assert topk.selected(np.array([least, 0, least]), 2).tolist() == [1, 0]


def test_searches_of_nothing(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert topk.search(blocks.integer_vectors(frame.drop("label")), F.col("vec_id") % 5 == 0).collect() == []
    assert negatives.mine(blocks.integer_vectors(frame), F.col("vec_id") % 5 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, "", "", "")], VECTORS)
    assert topk.search(blocks.integer_vectors(alone.drop("label")), F.col("vec_id") % 5 == 0).collect() == []
    assert negatives.mine(blocks.integer_vectors(alone), F.col("vec_id") % 5 == 0).collect() == []


def mined_plainly(rows, step):
    part = [r for r in taking_part(rows) if r[1] is not None]
    out = []
    for anchor in part:
        if anchor[0] is None or anchor[0] % step:
            continue
        order = ranked(anchor, part)
        for score, positive in [f for f in order if f[1][1] == anchor[1]][:5]:
            close = [f for f in order if f[1][1] != anchor[1] and 50 * score <= 100 * f[0] <= 95 * score]
            out += [(anchor[0], positive[0], k, f[1][0], score, f[0]) for k, f in enumerate(close[:3], 1)]
    return out


@pytest.mark.parametrize("numbers", [1 << 19, 60])
def test_hard_negatives_equal_the_definition(spark, monkeypatch, numbers):
    monkeypatch.setattr(blocks, "NUMBERS", numbers)
    rows = vectors(2, 150, size=3)
    got = negatives.mine(blocks.integer_vectors(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 5 == 0).collect()
    want = mined_plainly(rows, 5)
    assert len(want) > 60
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_label_and_equal_vectors_give_no_negatives(spark):
    rows = [(i, [0.5, 0.5], 1, "", "", "") for i in range(40)]
    got = negatives.mine(blocks.integer_vectors(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 5 == 0)
    assert got.count() == 0


def test_stream_opens_windows_before_negatives_of_equal_score():
    def pair(kind, score, vec_id):
        return negatives._key(kind, (0, 0, score, vec_id))
    pairs = sorted([pair(0, 0, 9), pair(1, 0, 3), pair(1, 0, 1), pair(1, 0, None), pair(1, 0, 2), pair(1, -5, 4)], key=lambda p: p[0])
    assert list(negatives.mined(iter(pairs), 3, (50, 95))) == [(0, 9, k, k, 0, 0) for k in (1, 2, 3)]
    assert negatives.bounds(-100, (50, 95)) == (1, 0)
    assert negatives.bounds(101, (50, 95)) == (51, 95)


def test_products_beyond_floating_point():
    big = np.array([[(1 << 31) + 1, 1]])
    assert negatives.products(big, big).tolist() == [[((1 << 31) + 1) ** 2 + 1]]


# ------------------------------------------------------------------ lexical search

def plain_terms(text):
    out, held = [], ""
    for c in (text or "") + " ":
        code = ord(c)
        if code >= 128 or c.isalnum():
            held += c.lower() if code < 128 else c
        elif held:
            out.append(held)
            held = ""
    return out


def ranked_plainly(docs, items, k=10):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for (doc, counts), size in zip(counted, sizes):
            if not total:
                continue
            m = 25 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * counts[t]) // (1000 * counts[t] + 8 * m))
                        for t in plain_terms(text) if counts[t])
            if score > 0:
                found.append((score, doc))
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(item, r, doc, score) for r, (score, doc) in enumerate(found[:k], 1)]
    return out


DOCS = "doc_id long, text string, n long, terms string, item string"
ITEMS = "item_id int, text string, doc_id string"


@pytest.mark.parametrize("block,together,portion", [(4096, 64, 2_000_000), (16, 1, 300)])
def test_lexical_search_equals_the_definition(spark, monkeypatch, block, together, portion):
    for name, value in (("BLOCK", block), ("TOGETHER", together), ("PORTION", portion)):
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(5)
    words = ["".join(r.choice("abcé中") for _ in range(r.randrange(1, 4))) for _ in range(140)]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(140)], k=r.randrange(1, 60)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, " .,-\x00\x7f "), (153, "İstanbul ISTANBUL istanbul"), (154, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]),
             (155, "abc_" * 3000)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 90)))) for i in range(12)]
    items += [(20, None), (21, "nowhere_x"), (22, "Abc abc ABC istanbul İstanbul"), (22, "abc"), (22, "abc"), (None, words[0]), (23, " ".join(words))]
    got = lexical.rank_documents(spark.createDataFrame([(*d, 1, "x", "y") for d in docs], DOCS),
                                 spark.createDataFrame([(*i, "z") for i in items], ITEMS))
    want = ranked_plainly(docs, items)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_lexical_search_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "abc", "")], ITEMS)
    assert lexical.rank_documents(none, items).collect() == []
    assert lexical.rank_documents(none, items.limit(0)).collect() == []
    assert lexical.rank_documents(spark.createDataFrame([(1, None, 1, "", "")], DOCS), items).collect() == []


def test_masks_group_documents_and_bound_their_scores():
    r = np.random.default_rng(3)
    rows, vocabulary = 300, 90
    lists = [np.sort(r.choice(vocabulary, r.integers(0, 30), replace=False)) for _ in range(rows)]
    term, lengths = np.concatenate(lists), np.array(list(map(len, lists)))
    tf = r.integers(1, 9, len(term))
    block = lexical._Block(list(range(rows)), lengths + 1, lengths, term, tf, rows, int(lengths.sum() + rows), vocabulary)
    wanted = r.permutation(vocabulary)[:70]
    weights = r.integers(0, 5000, 70)
    distinct, of = lexical.groups(block.masks(wanted))
    for d in range(rows):
        have = [t in set(lists[d].tolist()) for t in wanted]
        bits = [int(distinct[of[d], b >> 6]) >> (b & 63) & 1 == 1 for b in range(70)]
        assert have == bits
    room = np.zeros(vocabulary, np.int64)
    room[wanted] = weights
    scores = block.scores(np.arange(rows), room)
    most = lexical.maxima(distinct, weights * block.greatest[wanted])
    assert (scores <= most[of]).all()
    best = lexical._Best(5)
    scored = lexical._evaluate(block, wanted, weights, best, np.zeros(vocabulary, np.int64))
    order = np.lexsort((np.arange(rows), -scores))[:5]
    assert best.rows == [(int(scores[d]), int(d)) for d in order]
    assert scored < rows
