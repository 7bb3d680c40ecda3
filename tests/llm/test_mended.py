"""Cases that went wrong before: missing and repeated ids, full memories, signs inside words."""

import random

import numpy as np

from logrisk.llm import lines, minhash, pieces, toxicity, vectors


def near_texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    return " ".join(words), " ".join([*words[:-1], "other"])


def test_one_document_of_each_group_whatever_its_id(spark):
    a, b = near_texts()
    rows = [(None, a), (None, b), (None, b), (7, "quite another text with enough words in it"), (8, None), (8, None), (9, " ")]
    out = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), (100, 80)).collect()
    assert sum(r.text in (a, b) for r in out) == 1 and len(out) == 5
    rows = [(5, a), (5, b), (6, a)]
    out = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), (100, 80)).collect()
    assert len(out) == 1 and out[0].doc_id == 5
    rows = [(None, a), (4, b)]
    assert [r.doc_id for r in minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), (100, 80)).collect()] == [4]


def test_memory_keeps_what_was_used_lately():
    made = []
    memory = pieces._Memory(lambda k: made.append(k) or k.encode(), 40 * 230)
    for k in range(2000):
        assert memory[f"word{k}"] == f"word{k}".encode()
        assert memory["often"] == b"often"
    assert made.count("often") == 1 and len(memory) + len(memory.before) < 150


def test_fit_reads_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.fitting_rows(docs, labels)
    again = toxicity.fitting_rows(docs.repartition(5), labels)
    assert rows.doc_id.is_unique and rows.equals(again) and set(rows.doc_id) <= {1, 2, 3}


def test_signs_inside_words_are_read():
    assert toxicity.tokens("You f**k, it's (fine)!") == ["you", "f", "k", "f**k", "it", "s", "it's", "fine"]
    assert toxicity.tokens("@ss a_b") == ["ss", "@ss", "a_b"]
    assert toxicity.tokens(" .,! ") == []


def test_rough_vectors_and_their_error():
    r = np.random.default_rng(5)
    unit = r.standard_normal((200, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    values, step, error = vectors.rough(unit)
    off = np.abs(unit @ unit.T - unit @ (values * step[:, None]).T)
    assert (off <= error[None, :] + 1e-12).all() and error.max() < 0.02


def test_packed_keys_bring_near_lines_together():
    """Every near pair is among the candidates, also with few lines made into pairs at once."""
    import pyarrow as pa

    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh ijkl") for _ in range(n)) for n in (40, 79, 90, 200, 700)]
    texts = []
    for t in base:
        for _ in range(12):
            s = list(t)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                s[r.randrange(len(s))] = r.choice("xyz")
            texts.append("".join(s).strip())
    texts = [t for t in dict.fromkeys(texts) if len(t) >= 30]
    packed = list(lines._packed(lines.EDITS, 30, 4)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    blocks: dict = {}
    for b in packed:
        for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            blocks.setdefault(k, []).append(e)
    rows = [pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(v, pa.binary())], ["block", "entries"]) for k, v in sorted(blocks.items())]
    name = {t: lines._hashes(t)[0] & ((1 << lines.NAME) - 1) for t in texts}
    near = {tuple(sorted((name[x], name[y]))) for i, x in enumerate(texts) for y in texts[i + 1:] if lines.within([x], [y], lines.EDITS)[0]}
    assert len(near) > 40
    found = {(a, b) for batch in lines._candidates(lines.EDITS)(iter(rows)) for key, a, b in zip(*(c.to_pylist() for c in batch.columns)) if key is None}
    assert near <= found
