"""Exact dedup, pieces and MinHash near-duplicates against plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from logrisk.llm import exactdup, graph, minhash, pieces, queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(5, "a  b\n\tc"), (3, "a b c"), (9, None), (8, ""), (7, " "), (7, "  "), (None, "a b\x0bc"), (None, "only null id"),
       (2, "x" * 200_000), (2, "x" * 200_000), (1, "a\xa0b"), (11, "ＡＢ é")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "s") for i, t in rows], "doc_id long, text string, digest string, uid string")


# ------------------------------------------------------------------ exact dedup

def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        best = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, best, len(ids), sha) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [2, 65_536])
def test_exact_odd_rows(spark, shard):
    got = exactdup.dedup(frame(spark, ODD), shard=shard).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain_exact(ODD)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exactdup.dedup(frame(spark, [])).count() == 0


def test_exact_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    got = queries.REGISTERED["op2_exact_hash"](spark, MIDDLE).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    made = exactdup.Hash.build(words)
    assert sorted(made.slots(words)) == list(range(5000))
    assert len(made.bits) < 5 * 5000
    assert len(exactdup.Hash.build(words[:0]).slots(words[:3])) == 3
    with pytest.raises(ValueError):
        exactdup.Hash.build(np.concatenate([words, words[:1]]))


# ------------------------------------------------------------------ pieces

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.model_file())


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary.load(queries.model_file()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["the", " ", "  ", "\n", "ing", "▁", "é", "漢", "😀", "\x00", "def ", "    "]), st.text(max_size=6)), max_size=12))
def test_pieces_like_the_library(parts):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    encoder = test_pieces_like_the_library.made
    text = "".join(parts)
    assert list(encoder.encode(text)) == model.encode(text)
    assert encoder.decode(encoder.encode(text)) == model.decode(model.encode(text))


test_pieces_like_the_library.made = pieces.Encoder(pieces.Vocabulary.load(queries.model_file()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300)), max_size=8))
def test_decoding_like_the_library(ids):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    assert test_pieces_like_the_library.made.decode(ids) == model.decode(ids)


def test_long_runs(encoder, library):
    for text in (" " * 3001, "a" * 40_000, "\n" * 900, "▁" * 77, "ab" * 9000 + " " * 64 + "é" * 999):
        assert list(encoder.encode(text)) == library.encode(text)


def test_backtracking_needs_shorter_pieces(encoder):
    # Searching for the longest piece only is not merging.
    wrong = 0
    for r in ("unthinkable", "thanedbleanedity", "whndlyanblear"):
        text, greedy = pieces.SPACE + r, []
        while text:
            best = next(text[:k] for k in range(len(text), 0, -1) if text[:k] in encoder.ids)
            greedy.append(best)
            text = text[len(best):]
        wrong += greedy != encoder.split(pieces.SPACE + r)
        assert encoder.split(pieces.SPACE + r) == encoder.merged(pieces.SPACE + r)
    assert wrong


def test_pieces_over_the_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = queries.REGISTERED["op5_pieces"](spark, MIDDLE).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_odd_rows(spark, library):
    got = pieces.round_trip(frame(spark, ODD), queries.model_file()).collect()
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in ODD), key=repr)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == want
    back = pieces.decoded(pieces.round_trip(frame(spark, ODD), queries.model_file()), queries.model_file())
    assert sorted(r.text for r in back.collect()) == sorted(t for _, _, t in want)
    assert pieces.round_trip(frame(spark, []), queries.model_file()).count() == 0


# ------------------------------------------------------------------ near duplicates

def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain_near(rows):
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        near = {j for w in s for j in index[w]}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                parent[root(k)] = root(j)
        for w in s:
            index[w].append(k)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows))), key=repr)


def near(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_near_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    assert near(minhash.near_duplicates(spark.read.parquet(f"{MIDDLE}/documents.parquet"))) == plain_near(rows)


def test_near_odd_rows(spark):
    rows = ODD + [(20, "One two THREE four"), (21, "one  two three four\n"), (22, "one two three"), (23, "é É one two three four")]
    assert near(minhash.near_duplicates(frame(spark, rows))) == plain_near(rows)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.one_of_each(frame(spark, rows)).columns == ["doc_id", "text", "digest", "uid"]


def test_near_large_family(spark):
    """Variants of one text, in a chain and around a centre, with blocks of few rows."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.choice(200, rng.integers(0, 5), replace=False):
            words[j] = f"x{i}_{j}"
        rows.append((1000 - i, " ".join(words)))
    chain = [f"c{i}" for i in range(400)]
    for i in range(30):
        rows.append((2000 + i, " ".join(chain[6 * i:6 * i + 200])))
    blocks = minhash.KEY_BLOCK, minhash.BLOCK
    minhash.KEY_BLOCK, minhash.BLOCK = 16, 16
    try:
        got = near(minhash.near_duplicates(frame(spark, rows)))
    finally:
        minhash.KEY_BLOCK, minhash.BLOCK = blocks
    assert got == plain_near(rows)
    one = minhash.one_of_each(frame(spark, rows + rows[:5])).collect()
    assert sorted(r.doc_id for r in one) == sorted({r[2] for r in got})


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (500, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)
        row[at] = rng.integers(0, 1 << 16, len(at))
    assert (minhash.signature_keys(a) == minhash.signature_keys(b)).any(axis=1).all()


def test_bound_is_a_parameter(spark):
    assert [minhash.distance_of((100, b)) for b in (85, 80)] == [20, 24]
    words = [f"w{i}" for i in range(104)]
    # 100 shingles each; 90 in common of 110, so 0.818.
    rows = [(1, " ".join(words)), (2, " ".join(words[:94] + [f"x{i}" for i in range(10)])), (3, "a b c d e f")]
    found = {b: {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), (100, b)).collect()} for b in (80, 85)}
    assert found == {80: {1: 1, 2: 1, 3: 3}, 85: {1: 1, 2: 2, 3: 3}}
    assert sorted(r.doc_id for r in minhash.one_of_each(frame(spark, rows), (100, 80)).collect()) == [1, 3]
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(minhash.SYMBOLS, 24, replace=False)] += 1
    assert (minhash.signature_keys(a, 24) == minhash.signature_keys(b, 24)).any(axis=1).all()


def test_intersections():
    rng, columns = np.random.default_rng(2), minhash.COLUMNS
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 1, 5, 30, 30, 50)]
    minhash.COLUMNS = 7
    try:
        got = minhash.intersections(sets)
    finally:
        minhash.COLUMNS = columns
    assert (got == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_words_are_hashed_by_content():
    assert list(minhash.word_hashes("Ab  cd\tAB")) == list(minhash.word_hashes("\nab CD ab "))
    assert len(set(minhash.word_hashes("ab ba a b ab\x00 é É").tolist())) == 7
    long = "q" * 70_000
    assert minhash.word_hashes(long + "a")[0] != minhash.word_hashes(long + "b")[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 200)}, 200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
