"""Toxicity of texts: a bidirectional gated recurrent network with attention.

A text is read as words in overlapping windows. The input of a word joins a
vector of the word with the mean vector of its pieces of characters (both from
hashed tables). Forward and backward gated units run over the window, attention
weighs their states, and one number comes out. The score of a text is that of
its highest window. Training is gradient descent in numpy, written out here:
every labelled text teaches through its highest window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import kept, stored

#: Words of a window, and from one window's start to the next.
WINDOW, STEP = 32, 24
WORDS, GRAMS = 16_384, 8_192
#: Grams whose rows are remembered.
GRAMS_KEPT = 50_000
WIDE, STATE, LOOK = 12, 8, 8
#: Labelled texts that the fit reads at most, for each label, and their greatest length.
FIT_ROWS, FIT_CHARS = 1_500, 20_000
REMEMBERED = 100_000
#: Windows that are scored together.
TOGETHER = 2_048
#: Letters of a word; a longer run is read as words of so many that overlap by half.
LONGEST = 24
TOKEN = re.compile(r"\w+")
#: Signs around a run that do not belong to it.
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—/\\"


@dataclass
class Weights:
    """Parameters, all float32. A gated unit holds update, reset and candidate side by side."""

    word: np.ndarray
    gram: np.ndarray
    fw: np.ndarray
    fu: np.ndarray
    fb: np.ndarray
    bw: np.ndarray
    bu: np.ndarray
    bb: np.ndarray
    aw: np.ndarray
    ab: np.ndarray
    av: np.ndarray
    ow: np.ndarray
    ob: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Weights:
        rng = np.random.default_rng(seed)

        def made(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        gate, both = {}, 2 * STATE
        for side in "fb":
            gate[side + "w"] = made(2 * WIDE, 3 * STATE, scale=(2 * WIDE) ** -0.5)
            gate[side + "u"] = made(STATE, 3 * STATE, scale=STATE ** -0.5)
            gate[side + "b"] = np.zeros(3 * STATE, np.float32)
        return cls(word=made(WORDS, WIDE, scale=0.3), gram=made(GRAMS, WIDE, scale=0.3), **gate,
                   aw=made(both, LOOK, scale=both ** -0.5), ab=np.zeros(LOOK, np.float32), av=made(LOOK, scale=0.5),
                   ow=made(both, scale=0.3), ob=np.full(1, -1.0, np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tokens(text: str) -> list[str]:
    """Words in small letters; more than LONGEST letters in a row in overlapping parts.

    What stands between blanks and has signs inside (f**k) comes as a whole as
    well, behind its words, so that its characters can be read.
    """
    out: list[str] = []
    for run in text.lower().split():
        if len(run) <= LONGEST and run.isalnum():
            out.append(run)
        else:
            out += _words_of(run)
    return out


@lru_cache(50_000)
def _short_run(run: str) -> tuple[str, ...]:
    return tuple(_cut_run(run))


def _words_of(run: str) -> tuple[str, ...] | list[str]:
    return _short_run(run) if len(run) <= LONGEST else _cut_run(run)


def _cut_run(run: str) -> list[str]:
    words = TOKEN.findall(run)
    core = run.strip(EDGES)
    if words and words != [core]:
        words.append(core)
    out: list[str] = []
    for word in words:
        if len(word) <= LONGEST:
            out.append(word)
        else:
            out += [word[k:k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]
    return out


class GramRows(dict):
    """Rows of the character table by gram. Words are many, their trigrams few."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= GRAMS_KEPT:
            self.clear()
        row = self[gram] = xxhash.xxh3_64_intdigest(gram.encode()) % GRAMS
        return row


def word_parts(word: str, rows: GramRows | None = None) -> tuple[int, list[int]]:
    """Rows of the word table and of the character table; 0 is for no word.

    Characters come as trigrams and as beginnings of 4 to 6 with the edge.
    """
    rows, edged = GramRows() if rows is None else rows, f"<{word}>"
    size = len(edged)
    grams = [rows[edged[k:k + 3]] for k in range(size - 2)]
    if size >= 4:
        grams.append(rows[edged[:4]])
        # Longer beginnings are nearly as many as words.
        grams += [xxhash.xxh3_64_intdigest(edged[:k].encode()) % GRAMS for k in range(5, min(6, size) + 1)]
    return 1 + xxhash.xxh3_64_intdigest(word.encode()) % (WORDS - 1), grams


def windows(n: int) -> np.ndarray:
    """First words of the windows over n words; the last one reaches the end."""
    return np.array([*range(0, max(1, n - WINDOW + STEP), STEP)])


def _unit(x: np.ndarray, u: np.ndarray, live: np.ndarray, kept: list | None) -> np.ndarray:
    """States of a gated unit over steps; x: steps, windows, 3 * STATE (inputs already weighed)."""
    h = np.zeros((x.shape[1], STATE), np.float32)
    out = np.empty((x.shape[0], x.shape[1], STATE), np.float32)
    gates, cand = np.ascontiguousarray(u[:, :2 * STATE]), np.ascontiguousarray(u[:, 2 * STATE:])
    for t in range(x.shape[0]):
        zr = sigmoid(x[t, :, :2 * STATE] + h @ gates)
        z, r = zr[:, :STATE], zr[:, STATE:]
        c = np.tanh(x[t, :, 2 * STATE:] + (r * h) @ cand)
        new = h + live[t, :, None] * (z * (c - h))
        if kept is not None:
            kept.append((h, z, r, c))
        out[t] = h = new
    return out


def _attended(states: np.ndarray, live: np.ndarray, w: Weights):
    look = np.tanh(states @ w.aw + w.ab)
    heat = look @ w.av + np.where(live > 0, 0, -1e9).astype(np.float32)
    heat = np.exp(heat - heat.max(axis=0))
    share = heat / heat.sum(axis=0)
    pooled = (share[:, :, None] * states).sum(axis=0)
    return look, share, pooled, pooled @ w.ow + w.ob[0]


def logits(x_fw: np.ndarray, x_bw: np.ndarray, live: np.ndarray, w: Weights, kept: tuple | None = None):
    """Numbers of windows; x_fw and x_bw: steps, windows, weighed inputs of the two directions."""
    forward = _unit(x_fw, w.fu, live, kept and kept[0])
    backward = _unit(x_bw[::-1], w.bu, live[::-1], kept and kept[1])[::-1]
    states = np.concatenate([forward, backward], axis=2)
    return states, *_attended(states, live, w)


# ------------------------------------------------------------------ training

def _unit_back(x: np.ndarray, u: np.ndarray, live: np.ndarray, kept: list, d_out: np.ndarray):
    d_x, d_u = np.zeros_like(x), np.zeros_like(u)
    d_h = np.zeros_like(d_out[0])
    gates, cand = u[:, :2 * STATE], u[:, 2 * STATE:]
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c = kept[t]
        d_h = d_h + d_out[t]
        d = d_h * live[t, :, None]
        d_c, d_z = d * z * (1 - c * c), d * (c - h)
        back = d_c @ cand.T
        d_zr = np.concatenate([d_z * z * (1 - z), back * h * r * (1 - r)], axis=1)
        d_x[t, :, :2 * STATE], d_x[t, :, 2 * STATE:] = d_zr, d_c
        d_u[:, :2 * STATE] += h.T @ d_zr
        d_u[:, 2 * STATE:] += (r * h).T @ d_c
        d_h = d_h - d * z + back * r + d_zr @ gates.T
    return d_x, d_u


def gradients(ids: np.ndarray, grams: np.ndarray, means: np.ndarray, label: np.ndarray, w: Weights):
    """Loss and gradients for windows. ids: windows, steps; grams, means: trigram rows and shares per word row."""
    ids = ids.T
    live = (ids > 0).astype(np.float32)
    x = np.concatenate([w.word[ids], (w.gram[grams[ids]] * means[ids][..., None]).sum(axis=2)], axis=2)
    x_fw, x_bw = x @ w.fw + w.fb, x @ w.bw + w.bb
    kept: tuple = ([], [])
    states, look, share, pooled, out = logits(x_fw, x_bw, live, w, kept)
    p = sigmoid(out)
    d_out = ((p - label) / len(label)).astype(out.dtype)
    loss = float(-(label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7)).mean())
    g = {"ow": pooled.T @ d_out, "ob": d_out.sum(keepdims=True)}
    d_pooled = d_out[:, None] * w.ow
    d_states = share[:, :, None] * d_pooled
    d_share = (states * d_pooled).sum(axis=2)
    d_heat = share * (d_share - (share * d_share).sum(axis=0))
    g["av"] = np.einsum("twl,tw->l", look, d_heat)
    d_look = d_heat[:, :, None] * w.av * (1 - look * look)
    g["aw"], g["ab"] = np.einsum("tws,twl->sl", states, d_look), d_look.sum(axis=(0, 1))
    d_states = d_states + d_look @ w.aw.T
    d_fw, g["fu"] = _unit_back(x_fw, w.fu, live, kept[0], d_states[:, :, :STATE])
    d_bw, g["bu"] = _unit_back(x_bw[::-1], w.bu, live[::-1], kept[1], d_states[::-1, :, STATE:])
    d_bw = d_bw[::-1]
    flat = x.reshape(-1, x.shape[2])
    g["fw"], g["fb"] = flat.T @ d_fw.reshape(-1, 3 * STATE), d_fw.sum(axis=(0, 1))
    g["bw"], g["bb"] = flat.T @ d_bw.reshape(-1, 3 * STATE), d_bw.sum(axis=(0, 1))
    d_x = (d_fw @ w.fw.T + d_bw @ w.bw.T) * live[:, :, None]
    return loss, g, d_x


def fit(texts: list[str], labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Weights:
    """Weights learnt from whole texts; each teaches through its highest window."""
    w, rng = Weights.fresh(seed), np.random.default_rng(seed)
    known: dict[str, int] = {}
    rows = GramRows()
    parts: list[tuple[int, list[int]]] = [(0, [0])]
    spans, owner = [], []
    for i, text in enumerate(texts):
        ids = []
        for word in tokens(text):
            if word not in known:
                known[word] = len(parts)
                parts.append(word_parts(word, rows))
            ids.append(known[word])
        for s in windows(len(ids)):
            spans.append(ids[s:s + WINDOW] + [0] * (WINDOW - len(ids[s:s + WINDOW])))
            owner.append(i)
    spans, owner = np.array(spans, np.int32).reshape(-1, WINDOW), np.array(owner)
    row = np.array([p[0] for p in parts])
    longest = LONGEST + 3
    grams = np.zeros((len(parts), longest), np.int32)
    means = np.zeros((len(parts), longest), np.float32)
    for k, (_, g) in enumerate(parts):
        grams[k, :len(g)], means[k, :len(g)] = g, 1 / len(g) if k else 0
    m = {f.name: np.zeros_like(getattr(w, f.name)) for f in fields(w)}
    v = {name: np.zeros_like(x) for name, x in m.items()}
    step = 0
    for epoch in range(epochs):
        score = _scores(spans, row, grams, means, w)
        # The highest window of each text; before anything is learnt, one at random.
        rank = score if epoch else rng.random(len(score))
        order = np.lexsort((rank, owner))
        top = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
        if epoch:
            # Clean texts have no toxic window, so others of theirs teach as well.
            clean = np.flatnonzero(labels[owner] == 0)
            top = np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False)])
        else:
            toxic = np.flatnonzero(labels[owner] == 1)
            clean = np.flatnonzero(labels[owner] == 0)
            top = np.concatenate([toxic, rng.choice(clean, min(len(clean), 2 * len(toxic)), replace=False)])
        rng.shuffle(top)
        for start in range(0, len(top), batch):
            some = top[start:start + batch]
            ids = spans[some]
            _, g, d_x = _batch_gradients(ids, row, grams, means, labels[owner[some]].astype(np.float32), w)
            step += 1
            _sparse(w, g, d_x, ids, row, grams, means, m, v, step, rate)
    return w


def _batch_gradients(ids, row, grams, means, label, w):
    """Gradients with the word rows of the batch only."""
    some, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape)
    if some[0] != 0:
        some, at = np.concatenate([[0], some]), at + 1
    local = Weights(**{f.name: getattr(w, f.name) for f in fields(w)})
    local.word = w.word[row[some]]
    loss, g, d_x = gradients(at, grams[some], means[some], label, local)
    return loss, g, (d_x, some, at.T)


def _adam(x, g, m, v, step, rate):
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


def _sparse(w, g, d_x, ids, row, grams, means, m, v, step, rate):
    d_x, some, at = d_x
    for name, grad in g.items():
        _adam(getattr(w, name), grad, m[name], v[name], step, rate)
    per_word = np.zeros((len(some), d_x.shape[2]), np.float32)
    np.add.at(per_word, at.ravel(), d_x.reshape(-1, d_x.shape[2]))
    for name, grad, rows in (("word", per_word[:, :WIDE], row[some]),
                             ("gram", (per_word[:, None, WIDE:] * means[some][..., None]).reshape(-1, WIDE), grams[some].ravel())):
        touched, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(touched), WIDE), np.float32)
        np.add.at(total, place.ravel(), grad)
        x, mm, vv = (a[touched] for a in (getattr(w, name), m[name], v[name]))
        _adam(x, total, mm, vv, step, rate)
        getattr(w, name)[touched], m[name][touched], v[name][touched] = x, mm, vv


def _inputs(row, grams, means, w):
    """Weighed inputs of all words for both directions, some thousand words at a time."""
    x_fw = np.empty((len(row), 3 * STATE), np.float32)
    x_bw = np.empty_like(x_fw)
    for k in range(0, len(row), 4096):
        at = slice(k, k + 4096)
        x = np.concatenate([w.word[row[at]], np.einsum("nkd,nk->nd", w.gram[grams[at]], means[at])], axis=1)
        if not k:
            x[0] = 0
        x_fw[at], x_bw[at] = x @ w.fw + w.fb, x @ w.bw + w.bb
    return x_fw, x_bw


def _scores(spans, row, grams, means, w) -> np.ndarray:
    x_fw, x_bw = _inputs(row, grams, means, w)
    return window_logits(spans, x_fw, x_bw, w)


def window_logits(spans: np.ndarray, x_fw: np.ndarray, x_bw: np.ndarray, w: Weights) -> np.ndarray:
    out = np.empty(len(spans), np.float32)
    for k in range(0, len(spans), TOGETHER):
        ids = spans[k:k + TOGETHER].T
        out[k:k + TOGETHER] = logits(x_fw[ids], x_bw[ids], (ids > 0).astype(np.float32), w)[-1]
    return out


class Scorer:
    """Scores whole texts; remembers the weighed inputs of words."""

    def __init__(self, w: Weights):
        self.w, self.rows = w, GramRows()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.x_fw = np.zeros((1024, 3 * STATE), np.float32)
        self.x_bw = np.zeros((1024, 3 * STATE), np.float32)
        self.x_fw[0], self.x_bw[0] = self.w.fb, self.w.bb

    def _learn(self, words: list[str]) -> None:
        start = 1 + len(self.known)
        while len(self.x_fw) < start + len(words):
            self.x_fw, self.x_bw = (np.concatenate([x, np.zeros_like(x)]) for x in (self.x_fw, self.x_bw))
        for k in range(0, len(words), 4096):
            parts = [word_parts(x, self.rows) for x in words[k:k + 4096]]
            x = np.zeros((len(parts), 2 * WIDE), np.float32)
            x[:, :WIDE] = self.w.word[[p[0] for p in parts]]
            grams = [g for _, g in parts]
            size = np.array(list(map(len, grams)))
            flat = self.w.gram[np.fromiter(chain.from_iterable(grams), np.int64, int(size.sum()))]
            x[:, WIDE:] = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(size)[:-1]])) / size[:, None]
            at = slice(start + k, start + k + len(parts))
            self.x_fw[at], self.x_bw[at] = x @ self.w.fw + self.w.fb, x @ self.w.bw + self.w.bb
        self.known.update(zip(words, range(start, start + len(words))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; texts without words get that of an empty window."""
        if len(self.known) > REMEMBERED:
            self._forget()
        read = [tokens(t or "") for t in texts]
        new = [x for x in dict.fromkeys(chain.from_iterable(read)) if x not in self.known]
        if new:
            self._learn(new)
        starts, flat, at, owner = [], [], 0, []
        for i, words in enumerate(read):
            here = windows(len(words))
            starts.append(here + at)
            owner.append(np.full(len(here), i))
            flat.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
            # Room behind the words, so that no window reaches the next text.
            flat.append(np.zeros(WINDOW, np.int32))
            at += len(words) + WINDOW
        if not texts:
            return np.zeros(0)
        starts, owner, flat = np.concatenate(starts), np.concatenate(owner), np.concatenate(flat)
        best = np.full(len(texts), -np.inf, np.float32)
        for k in range(0, len(starts), 16 * TOGETHER):
            some = slice(k, k + 16 * TOGETHER)
            spans = flat[starts[some][:, None] + np.arange(WINDOW)]
            np.maximum.at(best, owner[some], window_logits(spans, self.x_fw, self.x_bw, self.w))
        return sigmoid(best.astype(np.float64))


# ------------------------------------------------------------------ on tables

def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fitting_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> pd.DataFrame:
    """Texts and labels of the fit: at most `fit_rows` of each label, by the smallest hash of the id.

    A bounded sample by its parameters: rows for each label, and characters of
    each text (longer texts are left out whole, none is cut).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fit_texts = texts.where(F.length("text").between(1, fit_chars))
    ids = stored(fit_texts.select("doc_id").distinct().join(known, "doc_id"), "toxic-known")
    chosen = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for k in (0, 1)]
    chosen = stored(chosen[0].unionByName(chosen[1]), "toxic-fit")
    # At most 2 * fit_rows ids, and one text of each: the least one, however often the id repeats.
    found = fit_texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas()
    return found.sort_values(["doc_id"]).reset_index(drop=True)


def _scorer(shared) -> Scorer:
    """One scorer in a Python worker, kept between its tasks."""
    name, w = shared.value
    return kept("toxicity", name, lambda: Scorer(w))


def train(docs: DataFrame, labels: DataFrame, **options) -> Weights | None:
    """A network fitted on the labelled documents; None if there are not both labels."""
    rows = fitting_rows(docs, labels, **options)
    if rows["toxic"].nunique() < 2:
        return None
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy())


def score(docs: DataFrame, w: Weights | None) -> DataFrame:
    """One row per row: doc_id, text_key, score. docs: doc_id, text (further columns are not read).

    Null and empty texts are scored as one empty window. Without a network
    every score is 0. text_key is xxhash64 of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    if w is None:
        return rows.select("doc_id", "text_key", F.lit(0.0).alias("score"))
    name = xxhash.xxh3_128_digest(b"".join(getattr(w, f.name).tobytes() for f in fields(w)))
    shared = docs.sparkSession.sparkContext.broadcast((name, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scorer.scores(part.column(2).to_pylist()), pa.float64())],
                    ["doc_id", "text_key", "score"])

    return rows.mapInArrow(run, "doc_id long, text_key long, score double")


def clean(docs: DataFrame, w: Weights | None, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, all columns, in one pass without a shuffle.

    Null and empty texts are scored as one empty window; repeated rows all stay
    or all go. Without a network nothing goes.
    """
    if w is None:
        return docs
    at = docs.columns.index("text")
    name = xxhash.xxh3_128_digest(b"".join(getattr(w, f.name).tobytes() for f in fields(w)))
    shared = docs.sparkSession.sparkContext.broadcast((name, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array(scorer.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
