"""Repeated lines against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logrisk.llm import lines, queries

SMALL = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=12), st.text("abé", max_size=12)), max_size=8), st.integers(0, 5))
def test_band_is_edit_distance(pairs, edits):
    got = lines.within([a for a, _ in pairs], [b for _, b in pairs], edits)
    assert list(got) == [distance(a, b) <= edits for a, b in pairs]


def edited(rng, text, edits):
    for _ in range(edits):
        k, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:k] + ("" if kind == 0 else rng.choice("xyz")) + text[k + (kind != 1):]
    return text


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 4])
def test_near_lines_share_a_key(edits):
    rng, places = random.Random(edits), lines._Places(edits, 1)

    def keys(t, own):
        return {(k, n, t[x:y]) for k, n, x, y, index in places(len(t)) if index or not own}
    for _ in range(400):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(12, 40)))
        b = edited(rng, a, rng.randint(0, edits))
        a, b = sorted((a, b), key=len)
        assert keys(a, True) & keys(b, False)


def plain_lines(rows, edits, least):
    different, where = {}, defaultdict(list)
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            line = line.strip(lines.BLANK)
            if len(line) >= least:
                different.setdefault(line, len(different))
                where[line].append((i is None, i or 0, pos))
    names = list(different)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(names)):
        for y in range(x):
            if abs(len(names[x]) - len(names[y])) <= lines.allowed(min(len(names[x]), len(names[y])), edits) and lines.within([names[x]], [names[y]], edits)[0]:
                parent[root(x)] = root(y)
    first = {}
    for line, k in different.items():
        first[root(k)] = min(first.get(root(k), (True, 1 << 70, 0)), *where[line], (True, 1 << 70, 0))
    out = []
    for i, t in rows:
        drop = [pos for pos, line in enumerate((t or "").split("\n"))
                if (s := line.strip(lines.BLANK)) in different and (i is None, i or 0, pos) > first[root(different[s])]]
        out.append((i, (t or "").count("\n") + 1, drop))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, line string")


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.dropped) for r in df.collect()), key=repr)


@pytest.mark.parametrize("edits, block", [(1, 64), (2, 4)])
def test_lines_like_brute_force(spark, edits, block):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 40))) for _ in range(12)]
    rows = [(rng.randrange(30) if rng.random() < 0.9 else None, None) for _ in range(1)]
    for i in range(60):
        some = [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 5))]
        rows.append((100 - i, rng.choice(["\n", "\n \n", " \r\n"]).join(some)))
    rows += [(5, "  one two three four  \n\n"), (4, "one two three four"), (None, "one two three four"), (3, ""), (2, "z" * 50_000 + "\n" + "z" * 50_001)]
    old, lines.BLOCK = lines.BLOCK, block
    try:
        assert got(lines.repeated_lines(frame(spark, rows), edits, 12)) == plain_lines(rows, edits, 12)
    finally:
        lines.BLOCK = old


def test_lines_over_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(lines.repeated_lines(docs)) == plain_lines(rows, lines.EDITS, lines.LEAST)
    out = queries.REGISTERED["op9_line_edits"](spark, SMALL)
    assert out.count() == len(rows)


def test_texts_without_repeats(spark):
    a, b = "a line that is long enough to be counted", "another line that is long enough too"
    rows = [(1, f"{a}\n{b}"), (2, f"short\n{a}x\nend"), (3, b), (4, None), (5, ""), (6, "short"), (7, f"{b}\n\n")]
    out = {r.doc_id: r.text for r in lines.without_repeats(frame(spark, rows)).collect()}
    assert out == {1: f"{a}\n{b}", 2: "short\nend", 4: None, 5: "", 6: "short"}
    assert lines.without_repeats(frame(spark, rows)).columns == ["doc_id", "text", "h", "line"]
    assert lines.repeated_lines(frame(spark, [])).count() == 0


def test_repeated_rows_keep_their_lines(spark):
    a = "a line that is long enough to be counted"
    assert got(lines.repeated_lines(frame(spark, [(1, a), (1, a), (2, a)]))) == [(1, 1, []), (1, 1, []), (2, 1, [0])]


def test_long_pairs():
    a = "x" * 70_000
    assert list(lines.within([a, a, ""], [a[:-1], a[:-3] + "yyy", ""], 2)) == [True, False, True]
    assert isinstance(lines.within([], [], 1), np.ndarray)


def test_longer_lines_may_have_more_edits(spark):
    rng, rows = random.Random(11), []
    base = ["".join(rng.choice("abcdefgh ijkl") for _ in range(n)) for n in (78, 80, 81, 119, 121, 199, 240, 500, 900, 2600)]
    for i in range(60):
        some = [edited(rng, t, rng.randint(0, len(t) // 40 + 1)) for t in rng.sample(base, 4)]
        rows.append((i, "\n".join(some)))
    want = plain_lines(rows, lines.Growing(1, 40), 30)
    assert got(lines.repeated_lines(frame(spark, rows))) == want
    assert sum(len(drop) for *_, drop in want) > 150 > sum(len(drop) for *_, drop in plain_lines(rows, 1, 30))
    assert got(lines.repeated_lines(frame(spark, rows), 1)) == plain_lines(rows, 1, 30)


def test_wide_band_is_edit_distance():
    rng = random.Random(4)
    for _ in range(60):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 90)))
        b = edited(rng, a, rng.randint(0, 9)) or "x"
        d, (y, x) = distance(a, b), sorted((a, b), key=len)
        assert all(lines._wide(x, y, e) == (d <= e) for e in range(len(x) - len(y), 40))


def test_a_task_holds_few_texts(monkeypatch):
    """Lines of some texts at a time, and nothing that another operator kept in the worker; the same keys."""
    from logrisk.llm import common

    texts = [f"line {k} " + "abcdefghij" * 4 + f"\nother {k} " + "klmnopqrst" * 12 for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    def keys():
        found: dict = {}
        for made in lines._packed(lines.EDITS, 30, 7)(iter([batch])):
            for block, entries in zip(made.column(0).to_pylist(), made.column(1).to_pylist()):
                found[block] = sorted(found.get(block, []) + [entries[k:k + lines.WIDTH] for k in range(0, len(entries), lines.WIDTH)])
        return found

    whole = keys()
    monkeypatch.setattr(lines, "TEXTS", 3)
    common.kept("toxicity", "some", dict)
    assert keys() == whole and not common._kept
    assert max(map(len, lines._new_lines(iter([batch]), 30))) <= 6
    ids = pa.array(range(40), pa.int64())
    rows = list(lines._lines(30)(iter([pa.RecordBatch.from_arrays([ids, ids, batch.column(0)], ["doc_id", "text_key", "text"])])))
    assert max(r.num_rows for r in rows) <= 9 and sum(r.num_rows for r in rows) == 120


def copies(rng, text, count, edits):
    return [edited(rng, text, rng.randint(0, edits)) for _ in range(count)]


def test_copies_of_one_line_make_few_rows():
    """Keys that many lines share give each line once for a hub, not once for a key, and not all pairs."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ijkl") for _ in range(600))
    some = sorted(set(copies(rng, text, 150, 25)))
    batch = pa.RecordBatch.from_arrays([pa.array(some)], ["text"])
    found = list(lines._candidates(lines.EDITS)(lines._packed(lines.EDITS, 30, 1)(iter([batch]))))
    assert 140 < sum(b.num_rows for b in found) < 20 * len(some)
    met = {x for b in found for k in (1, 2) for x in b.column(k).to_pylist()}
    assert len(met) == len(some)


def test_classes_within_many_copies(spark, monkeypatch):
    """Lines of a hub that its middle does not tie are compared with each other, in several blocks."""
    rng, rows = random.Random(12), []
    base = ["".join(rng.choice("abcdefgh ijkl") for _ in range(n)) for n in (90, 240, 500)]
    far = [edited(rng, t, len(t) // 15) for t in base]
    for i in range(40):
        some = [edited(rng, t, rng.randint(0, len(t) // 25)) for t in rng.sample(base + far, 3)]
        rows.append((i, "\n".join(some)))
    want = plain_lines(rows, lines.EDITS, 30)
    monkeypatch.setattr(lines, "FEW", 3)
    monkeypatch.setattr(lines, "BLOCK", 8)
    assert got(lines.repeated_lines(frame(spark, rows))) == want


def candidates(texts, blocks=4):
    """Rows (ties, a, b) of the candidates among some lines."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    by: dict = {}
    for made in lines._packed(lines.EDITS, 30, blocks)(iter([batch])):
        for block, entries in zip(made.column(0).to_pylist(), made.column(1).to_pylist()):
            by.setdefault(block, []).append(entries)
    rows = [pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(v, pa.binary())], ["block", "entries"])
            for k, v in sorted(by.items())]
    return [row for b in lines._candidates(lines.EDITS)(iter(rows)) for row in zip(*(c.to_pylist() for c in b.columns))]


@pytest.mark.parametrize("count", [12, 40])
def test_a_gram_alone_makes_no_candidates(count):
    """Lines that share a gram in one place, but no longer run, are told apart before their texts are read."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    grams = [some(lines.GRAM) for _ in range(40)]
    texts = [some(100) + g + some(100) for g in grams for _ in range(count)]
    assert candidates(texts) == []
    assert len({(a, b) for _, a, b in candidates([*texts, texts[0][:-1] + "z"])}) == 1


def test_only_lines_of_the_bit_table_are_read(spark):
    texts = [f"line {k} " + "abcdefghij" * 4 for k in range(300)]
    names = spark.createDataFrame([(lines._hashes(t)[0] & (1 << lines.NAME) - 1,) for t in texts[:20]], "n long")
    docs = spark.createDataFrame([("\n".join(texts[k:k + 30]),) for k in range(0, 300, 10)], "text string")
    found = lines._line_texts(docs, names, 30).collect()
    assert {r.line for r in found} >= set(texts[:20]) and len(found) < 40
    assert all(r.h == lines._hashes(r.line)[0] and r.n == r.h & (1 << lines.NAME) - 1 for r in found)


def test_pairs_of_several_bounds_share_a_band():
    rng, pairs = random.Random(8), []
    for n in (60, 90, 130, 200, 700, 1300, 1700):
        for _ in range(15):
            a = "".join(rng.choice("abcé ") for _ in range(n))
            pairs.append((a, edited(rng, a, rng.randint(0, n // 20))))
    want = [distance(a, b) <= lines.allowed(min(len(a), len(b)), lines.EDITS) for a, b in pairs]
    assert list(lines.within(*zip(*pairs), lines.EDITS)) == want and 20 < sum(want) < 90
