"""Exact merge-type encoding of texts with a piece vocabulary, and decoding.

The merges of a text are those of greedy merging by score if and only if every
two neighbours, merged on their own, stay as they are: merging inside a piece
never depends on what lies outside until a merge crosses its border. So a
search from the left needs no merge queue: take the longest piece that matches
here (all matches come from one Aho-Corasick pass), check it with its left
neighbour, go on; if it does not fit take the next shorter one, and if none is
left go one piece back. A position is never tried twice: the pieces up to it
are the only valid ones, so a bit field remembers where no continuation exists.

Parts between which no piece of the vocabulary reaches are encoded on their own
and remembered, which makes common words cheap.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from sys import getsizeof

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import kept

SPACE = "▁"
#: Bytes of a generation of remembered words, parts or neighbours in a Python worker; two generations are held.
REMEMBERED = {"words": 72 << 20, "parts": 24 << 20, "fits": 24 << 20}
#: Bytes that an entry takes beside its key and its value.
ENTRY = 120
#: Texts that are handled and passed on together.
SLICE = 256


@dataclass(frozen=True)
class Vocabulary:
    """What is needed of a model file; about a megabyte, sent to every executor once."""

    pieces: tuple
    scores: tuple
    #: n normal, b byte, c control, u unknown
    kinds: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " AéＡ  Ⅷ\t\n "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models without normalisation, with a leading space, are supported")
        every = range(model.get_piece_size())
        kinds = "".join("b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i)
                        else "x" if model.is_unused(i) else "n" for i in every)
        if "x" in kinds or kinds.count("b") not in (0, 256):
            raise ValueError("models with unused pieces or a part of the bytes are not supported")
        return cls(tuple(map(model.id_to_piece, every)), tuple(map(model.get_score, every)), kinds)


class _Memory(dict):
    """Results of a function. What was asked for lately stays when older results are forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.size, self.before = make, most, 0, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self.size += getsizeof(key) + getsizeof(value) + ENTRY
        if self.size > self.most:
            # The younger generation becomes the older one, which is forgotten.
            self.before, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        pieces, kinds = vocabulary.pieces, vocabulary.kinds
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == "n"}
        self.score = {p: vocabulary.scores[i] for p, i in self.ids.items()}
        self.unknown = kinds.find("u")
        self.bytes = [i for i, k in enumerate(kinds) if k == "b"]
        long = [p for p in self.ids if len(p) > 1]
        self.shorter, self.search = {}, ahocorasick.Automaton()
        # Pieces that merging never makes are no pieces for the search.
        made = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        for p in made:
            self.search.add_word(p, p)
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in made or k == 1), None)
        self.search.make_automaton()
        self.fits = _Memory(lambda pair: self.merged(pair[0] + pair[1]) == list(pair), REMEMBERED["fits"])
        # Where no piece reaches across, the two sides are encoded on their own.
        joined = set("".join(long))
        self.alone = "\n" not in joined
        self.spaced = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long)
        self.part = _Memory(self._part, REMEMBERED["parts"])
        self.word = _Memory(lambda w: self._part(SPACE + w), REMEMBERED["words"])
        self._surfaces(vocabulary)

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, text: str) -> list[str]:
        """The merged parts of a text, by search with backtracking."""
        size = len(text)
        longest = list(text)
        for end, piece in self.search.iter(text):
            longest[end + 1 - len(piece)] = piece
        shorter, fits = self.shorter, self.fits
        failed, out, at, piece = bytearray(size // 8 + 1), [], 0, longest[0] if size else None
        while at < size:
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = shorter.get(piece)
                continue
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits[out[-1], piece]):
                out.append(piece)
                at = end
                piece = longest[at] if at < size else None
            else:
                piece = shorter.get(piece)
        return out

    def _part(self, text: str) -> bytes:
        """Ids of a part, packed."""
        out = array("i")
        for p in self.split(text):
            known = self.ids.get(p)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, text: str) -> array:
        """Ids of a text, without begin or end."""
        packed = array("i")
        packed.frombytes(self._packed(text))
        return packed

    def _packed(self, text: str) -> bytes:
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if not self.spaced:
            return self._part(text)
        out: list[bytes] = []
        newline = self.part["\n"] if self.alone else None
        for k, line in enumerate(text.split("\n") if self.alone else [text]):
            if k:
                out.append(newline)
            if SPACE + SPACE in line:
                out += map(self.part.__getitem__, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line))
                continue
            head, *rest = line.split(SPACE)
            if head:
                out.append(self.part[head])
            out += map(self.word.__getitem__, rest)
        return b"".join(out)

    def _surfaces(self, vocabulary: Vocabulary) -> None:
        first = self.bytes[0] if self.bytes else 0
        self.surface, self.kinds = [], vocabulary.kinds
        for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)):
            ascii_byte = chr(i - first) if k == "b" and i - first < 128 else ""
            self.surface.append({"c": "", "u": " ⁇ ", "b": ascii_byte}.get(k, p.replace(SPACE, " ")))
        self.high = (first + 128, first + 255) if self.bytes else (0, -1)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if not ((ids >= self.high[0]) & (ids <= self.high[1])).any():
            text = "".join(map(self.surface.__getitem__, ids.tolist()))
        else:
            first, parts, run = self.bytes[0], [], bytearray()
            for i in ids.tolist():
                if first <= i < first + 256:
                    run.append(i - first)
                    continue
                parts += [_text(run), self.surface[i]]
                run = bytearray()
            text = "".join([*parts, _text(run)])
        first = next((i for i in ids.tolist() if self.kinds[i] != "c"), None)
        return text[1:] if first is not None and self.kinds[first] == "n" and self.surface[first][:1] == " " else text


def _text(run: bytearray) -> str:
    """Bytes as text; each byte that belongs to no character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(run):
        try:
            out.append(run[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [run[at:at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


def _encoder(shared) -> Encoder:
    """One encoder in a Python worker, kept between its tasks."""
    return kept("pieces", shared.value, lambda: Encoder(shared.value))


def _lists(arrays: list[array]) -> pa.Array:
    flat = array("i")
    for a in arrays:
        flat.extend(a)
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())).cast(pa.list_(pa.int32()))


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per row: doc_id, ids (list of int), decoded.

    docs: doc_id, text (further columns are not read); null texts are empty
    and have no ids. Repeated rows and null ids stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                ids = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(ids), pa.array([encoder.decode(i) for i in ids], pa.string())],
                    ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """Texts of stored ids: doc_id, text. rows: doc_id, ids; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = [encoder.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")) \
        .mapInArrow(run, "doc_id long, text string")
