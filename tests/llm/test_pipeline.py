"""The pipeline, each stage on its own input against plain Python."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from test_copies import plain_near
from test_lines import plain_lines
from test_native import water

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from logrisk.llm import lines, queries, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Documents before and after each stage."""
    folder, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append((before, docs))
    return found


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(outputs):
    first = outputs[0][0].columns
    assert all(after.columns == first for _, after in outputs[:-1])
    assert {"doc_id", "n_tokens"} <= set(outputs[-1][1].columns)


def test_toxicity_stage(spark, outputs):
    before, after = outputs[0]
    w = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = rows(before)
    score = dict(zip((i for i, _ in texts), toxicity.Scorer(w).scores([t for _, t in texts])))
    assert sorted(rows(after)) == sorted(r for r in texts if score[r[0]] < 0.5)


def test_line_stage(outputs):
    before, after = outputs[1]
    texts = dict(rows(before))
    want = {}
    for i, _, drop in plain_lines(list(texts.items()), lines.EDITS, lines.LEAST):
        left = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
        if not drop or left.strip(lines.BLANK):
            want[i] = left
    assert dict(rows(after)) == want


def test_near_stage(outputs):
    before, after = outputs[2]
    assert sorted(i for i, _ in rows(after)) == sorted({c for _, _, c in plain_near(rows(before))})


def test_mixing_stage(outputs):
    before, after = outputs[3]
    size = {r.doc_id: len((r.text or "").split()) for r in before.collect()}
    source = {r.doc_id: r.source for r in before.collect()}
    taken, total, largest = Counter(), Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
        largest[source[i]] = max(largest[source[i]], n)
    copies = Counter(r.doc_id for r in after.collect())
    for i, k in copies.items():
        taken[source[i]] += k * size[i]
        assert k <= 2
    for s, goal in water(dict(total)).items():
        assert abs(taken[s] - goal) <= largest[s] + 1e-6


def test_piece_stage(outputs):
    before, after = outputs[4]
    model = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    want = []
    for i, t in rows(before):
        ids = model.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in after.collect()) == sorted(want)


def test_registered(spark, outputs):
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, SMALL).collect())) == sorted(map(tuple, outputs[-1][1].collect()))
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
