"""WARC archives, vector codes and the toxicity network."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict
from dataclasses import fields

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrisk.llm import queries, toxicity, vectors, warc

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# ------------------------------------------------------------------ archives

def plain_types(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = best.get(h or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


def contract(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, offset int")


ODD = [(1, "http://A.example.COM/x?q=1#f", "a"), (2, "http://a.example.com/x?q=1", "a"), (3, None, None), (4, "", ""),
       (5, "no scheme/é ü\n\t", "é" * 10_000), (5, "http://b.org", "é" * 10_000), (6, "http://" + "k" * 3000 + ".org/a", "z\r\n\r\n"),
       (6, "http://" + "k" * 3000 + ".org/a", "z\r\n\r\n"), (None, "http://b.org", "q"), (None, None, "a"), (7, "http://b.org", "x" * 3_000_000)]


def test_odd_pages(spark):
    assert contract(warc.round_trip(pages(spark, ODD))) == plain_types(ODD)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_pages_of_the_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()]
    assert contract(queries.REGISTERED["op1_warc_index"](spark, MIDDLE)) == plain_types(rows)


def test_lookup_by_key_over_blocks(spark):
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 50}.net/p{i}", f"body {i % 40}") for i in range(900)]
    made = warc.write(pages(spark, rows), archive_bytes=4000, lines=8)
    assert made.shards.agg(F.sum("blocks")).first()[0] >= 900 / 8
    assert made.captures.select("archive").distinct().count() > 3
    keys = spark.createDataFrame([("org,hot)/",), ("net,h3)/p3",), ("nowhere",), ("",), ("zz",)], "key string")
    found = made.lookup(keys, exact=False)
    want = sorted(i for i, u, _ in rows if u == "http://hot.org/") + [3]
    assert sorted(r.page_id for r in found.collect()) == sorted(want)
    some = spark.createDataFrame([("org,hot)/", 4), ("org,hot)/", 4), ("org,hot)/", 3), ("net,h3)/p3", 3)], "key string, page_id long")
    read = made.fetch(made.lookup(some)).collect()
    assert sorted(r.page_id for r in read) == [3, 4]
    bodies = {i: b for i, _, b in rows}
    for r in made.fetch(made.lookup(made.captures)).where("record_type = 'response'").collect():
        assert r.payload.decode() == bodies[r.page_id]


def test_records_are_readable():
    member = warc.record("response", 3, "http://a/\nb", b"\x00p\r\n\r\n", "D", None)
    fields_, head, payload = warc.parsed(member)
    assert payload == b"\x00p\r\n\r\n" and head["Content-Length"] == "6" and fields_["WARC-Target-URI"] == "http://a/ b"


# ------------------------------------------------------------------ vectors

def plain_vectors(rows, threshold=0.93):
    groups, links, parent = defaultdict(list), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, v, label) in enumerate(rows):
        ok = label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
        if ok:
            groups[label, len(v)].append(k)
    for members in groups.values():
        m = np.array([rows[k][1] for k in members], float)
        m /= np.sqrt((m * m).sum(axis=1))[:, None]
        cos = m @ m.T
        for i in range(len(members)):
            for j in range(i):
                if cos[i, j] >= threshold:
                    a, b = members[i], members[j]
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    comp = defaultdict(list)
    for k in range(len(rows)):
        comp[root(k)].append(rows[k][0])
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in comp.items()}
    return sorted(((rows[k][0], links[k], least[root(k)]) for k in range(len(rows))), key=repr)


def got_vectors(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


def test_vectors_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{LARGE}/embeddings.parquet").collect()]
    got = queries.REGISTERED["op3_vector_codes"](spark, LARGE)
    assert got_vectors(got) == plain_vectors(rows)


def test_vectors_in_small_cells(spark):
    """Many bits and tables, blocks of few rows, a large group of near copies and of equal rows."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, rng.standard_normal(16).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, (centre + rng.standard_normal(16) * 0.12).tolist(), 1) for i in range(120)]
    rows += [(2000 + i, centre.tolist(), i % 2) for i in range(60)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [float("inf")] + [1.0] * 15, 1),
             (3005, centre.tolist(), None), (None, centre.tolist(), 1), (3006, centre.tolist()[:8], 1), (3007, (centre * 1e200).tolist(), 1),
             (3008, (centre * 1e-200).tolist(), 1), (5, centre.tolist(), 1)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<double>, label int, node int, fp string")
    cell, block = vectors.CELL, vectors.BLOCK
    vectors.CELL, vectors.BLOCK = 32, 24
    try:
        assert vectors.tables(300, 0.93)[0] == 4
        got = got_vectors(vectors.near_vectors(df))
    finally:
        vectors.CELL, vectors.BLOCK = cell, block
    want = plain_vectors([(i, v, lab) for i, v, lab in rows if i not in (3007, 3008)] )
    got_links, want_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert got_links >= want_links * 0.99
    assert len(got) == len(rows)
    empty = spark.createDataFrame([], df.schema)
    assert vectors.near_vectors(empty).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, 400, 64))
    b = 0.7 * a + 0.6 * b
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    codes, factors = vectors.coded(a)
    value, error = vectors.estimate(codes, factors, b)
    off = value - a @ b.T
    assert abs(off.mean()) < 0.002 and (np.abs(off) > error[:, None]).mean() < 2e-5
    assert (off / error[:, None]).std() == pytest.approx(1 / vectors.CONFIDENCE, rel=0.1)


# ------------------------------------------------------------------ toxicity

def test_gradients():
    rng, w = np.random.default_rng(0), toxicity.Weights.fresh(1)
    for f in fields(w):
        setattr(w, f.name, getattr(w, f.name).astype(float))
    ids = rng.integers(1, 20, (5, toxicity.WINDOW))
    ids[2, 10:] = 0
    ids[3] = 0
    grams, means, label = rng.integers(0, 50, (20, 4)), rng.random((20, 4)), np.array([1, 0, 1, 0, 1.0])
    means[0] = 0
    _, g, _ = toxicity.gradients(ids, grams, means, label, w)
    for name, grad in g.items():
        a = getattr(w, name)
        place = tuple(rng.integers(0, s) for s in a.shape)
        old, side = a[place], []
        for step in (1e-4, -1e-4):
            a[place] = old + step
            side.append(toxicity.gradients(ids, grams, means, label, w)[0])
        a[place] = old
        assert (side[0] - side[1]) / 2e-4 == pytest.approx(grad[place], rel=0.05, abs=2e-6)


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        starts = toxicity.windows(n)
        covered = {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and (n == 0 or all(s < n for s in starts))


@pytest.fixture(scope="module")
def network(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels)


def test_held_out_documents(spark, network):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, network).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows])
    toxic = [r.score >= 0.5 for r in rows if r.toxic == 1]
    assert right > 0.96 and np.mean(toxic) > 0.85


def test_scores_whole_texts(spark, network):
    """A word at the end of a long text counts as much as at its start, and batches do not matter."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(40)
    scorer = toxicity.Scorer(network)
    texts = [r.text for r in docs.collect()] + [None, "", "!!! ...", "x" * 50_000]
    alone = [scorer.scores([t])[0] for t in texts]
    assert scorer.scores(texts) == pytest.approx(alone, abs=1e-5)
    calm = " ".join(random.Random(1).choices(["the", "and", "there", "of", "from", "with"], k=6000))
    bad = "you worthless idiot, pathetic moron and stupid loser "
    low, first, last = scorer.scores([calm, bad + calm, calm + " " + bad])
    assert low < 0.5 < min(first, last)


def test_odd_texts_and_labels(spark, network):
    rows = [(1, None), (1, None), (2, ""), (None, "you idiot"), (3, "é" * 9)]
    docs = spark.createDataFrame([(i, t, 0.5, "s") for i, t in rows], "doc_id long, text string, score double, source string")
    assert toxicity.score(docs, network).count() == 5
    assert toxicity.clean(docs, network).columns == docs.columns
    assert toxicity.score(docs.limit(0), network).count() == 0
    none = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.clean(docs, None).count() == 5


def test_whole_of_a_long_run_is_read():
    for n in (25, 36, 37, 48, 49, 400):
        run = "".join(chr(0x4E00 + k) for k in range(n))
        parts = toxicity.tokens(f"Ab {run} c_D")
        assert parts[0] == "ab" and parts[-1] == "c_d" and max(map(len, parts)) <= toxicity.LONGEST
        # Whatever is no longer than half a part stands in one of them whole.
        assert all(any(run[k:k + 12] in p for p in parts) for k in range(n - 11))
    clean, rude = "a" * 200, "a" * 90 + "idiot" + "a" * 105
    grams = [{g for p in toxicity.tokens(t) for g in toxicity.word_parts(p)[1]} for t in (clean, rude)]
    assert grams[1] - grams[0]


def test_a_worker_keeps_one_operator():
    """A worker that encoded and then scores holds the scorer alone: their memories do not add up."""
    import gc
    import weakref

    from logrisk.llm import pieces, queries, toxicity

    class Shared:
        def __init__(self, value):
            self.value = value

    coded = Shared(pieces.Vocabulary.load(queries.model_file()))
    network = Shared((b"w", toxicity.Weights.fresh(1)))
    encoder = weakref.ref(pieces._encoder(coded))
    assert pieces._encoder(coded) is encoder()
    scorer = toxicity._scorer(network)
    gc.collect()
    assert encoder() is None
    assert toxicity._scorer(network) is scorer


def test_trigrams_are_hashed_once(monkeypatch):
    """Words are many, their trigrams few: a scorer hashes each trigram once; the rows stay the same."""
    words = [f"wo{a}{b}rd{a}{b}s{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    alone = [toxicity.word_parts(w) for w in words]
    hashed, plain = [], toxicity.xxhash.xxh3_64_intdigest

    class Counting:
        @staticmethod
        def xxh3_64_intdigest(data):
            hashed.append(data)
            return plain(data)

    monkeypatch.setattr(toxicity, "xxhash", Counting)
    rows = toxicity.GramRows()
    assert [toxicity.word_parts(w, rows) for w in words] == alone
    assert len([h for h in hashed if len(h) == 3]) == len({w[k:k + 3] for w in (f"<{x}>" for x in words) for k in range(len(w) - 2)})
    monkeypatch.setattr(toxicity, "GRAMS_KEPT", 5)
    rows = toxicity.GramRows()
    assert [toxicity.word_parts(w, rows) for w in words] == alone and len(rows) <= 5
