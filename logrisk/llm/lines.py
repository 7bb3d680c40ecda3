"""Repeated lines, exact or with few edits, by shared segments and shared runs.

Two lines may differ by one edit for each 40 characters of the shorter one, and
by one at least (EDITS). While the bound is the least one, a line shares one of
bound + 1 segments with a near one unchanged, shifted by few places. Each line
indexes its segments under their number and its length, and looks up the substrings of
its own that could be the segment of a line as long or shorter; only the places
are tried that a segment can have when the edits left and right of it add up to
the bound. Where the bound grows, k edits leave a run of (length - k) / (k + 1)
characters that both lines hold; of each stretch of that length a line has the
gram of the smallest hash as key, so near lines share one always, and the keys
for each character stay as many however long a line is.

Most keys belong to one line. The keys of a task are packed into blocks of
bytes by their hash, with the hash of the line, roughly its length and the
place, and marks of the characters on both sides of a gram: of a run that two
lines share, what the gram leaves is half on one side of it at least, so one of
the marks is the same. A block is sorted as a whole; only keys of several lines
leave it, as pairs of lines whose lengths, places and marks allow the bound.
Pairs of all keys are made distinct before any text is read, and texts are
fetched only for lines in a pair, whose hashes a bit table of fixed size tells. The edit distance is a band of the dynamic program, held
as bits of a word that slides down the diagonal, after counts of characters and
of pairs of characters have ruled out what is too far.

Equal lines are one line from the start. Lines form classes, the components of
near pairs, and the first line of a class stays. A key that many lines share
names one of them its hub: that of the least hash, so the many keys that copies
of one line have in common name the same few hubs. The lines of a hub are
compared with the one among them that shares most such keys, as the copy with
the fewest edits does; only those that are still in different classes are then
compared with each other, in blocks, under the least hub of both and not for
each key; counts of characters rule out many pairs before any distance is found.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logrisk.llm.common import alone, forget, same, stored
from logrisk.llm.graph import components
from logrisk.llm.minhash import BITS, _mixed, bit_table


@dataclass(frozen=True)
class Growing:
    """A bound of one edit for each `per` characters of the shorter line, and `least` at least."""

    least: int
    per: int


#: Edits that still make a repeated line.
EDITS = Growing(1, 40)
#: Shorter lines, without the blanks around them, always stay.
LEAST = 30
#: Lines of one block when those of a hub are compared with each other.
BLOCK = 512
#: Different lines that a task remembers so as not to send them twice.
REMEMBERED = 200_000
#: Characters of a batch of pairs.
CELLS = 4_000_000
#: Pairs of lines that are compared together, and classes of lines that a task remembers.
ASKED, CLASSES = 4_000, 500_000
#: Characters whose keys are made together.
PORTION = 200_000
#: Edits whose band is held in a word of 64 bits, and columns of it that are compared at once.
WIDEST, COLUMNS = 30, 32
#: Characters of a gram.
GRAM = 16
#: Keys that a task packs together, and characters of the text for a block of keys, or of its lines for one of a hub.
PACKED, CHARACTERS = 1 << 20, 4_000_000
#: Texts whose lines a task holds at once.
TEXTS = 512
#: Lines of a key whose pairs are all made; more are tied to a hub.
FEW = 16
#: Pairs that are made together, and entries of keys of many lines.
MADE, CROWDED = 1 << 20, 1 << 16
#: Bits of the hash of a line in a packed key, its bytes, and the greatest length or place in it.
NAME, WIDTH, MOST = 39, 16, 65_535
#: Bits of a mark in a packed key: 0 if a line has too few characters on that side of a gram.
MARK = 12
BLANK = " \t\n\x0b\x0c\r"


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments; the longer ones come last."""
    count = edits + 1
    size, longer = divmod(length, count)
    out, at = [], 0
    for k in range(count):
        n = size + (k >= count - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, shorter: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings to look up among lines of `shorter` fewer characters.

    Looking from the left, segment k (from 0) has at most k edits before it,
    else an earlier segment would do; looking from the right likewise. Both
    bounds hold at once.
    """
    out = []
    for k, (at, size) in enumerate(segments(length - shorter, edits)):
        low = max(at - k, at + shorter - (edits - k), 0)
        high = min(at + k, at + shorter + (edits - k), length - size)
        out += [(k, start, size) for start in range(low, high + 1)]
    return out


def allowed(length: int, edits: int | Growing) -> int:
    """The bound of a pair whose shorter line has `length` characters."""
    return max(edits.least, length // edits.per) if isinstance(edits, Growing) else edits


class _Places:
    """Where to cut a line of each length: (number, length of the other, start, end, is index).

    Lines of `limit` characters and more are not indexed.
    """

    def __init__(self, edits: int, least: int, limit: int = 1 << 62):
        self.edits, self.least, self.limit, self.known = edits, least, limit, {}

    def __call__(self, length: int) -> list:
        if length not in self.known:
            own = segments(length, self.edits)
            cuts = [(k, length, at, at + n, 1) for k, (at, n) in enumerate(own)] if length < self.limit else []
            for shorter in range(self.edits + 1):
                if not self.least <= length - shorter < self.limit:
                    continue
                cuts += [(k, length - shorter, at, at + n, 0) for k, at, n in probes(length, shorter, self.edits)
                         if shorter or (at, n) != own[k]]
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[length] = cuts
        return self.known[length]


class _Grams:
    """Keys of lines whose bound grows, by ranges of length a quarter wider each."""

    def __init__(self, edits: int | Growing):
        self.edits, self.per = edits, edits.per if isinstance(edits, Growing) else 1
        self.first = self.per * (edits.least + 1) if isinstance(edits, Growing) else 1 << 62
        self.known: dict[int, range] = {}
        self.starts = [self.first]
        while self.starts[-1] < 1 << 31:
            self.starts.append(max(self.starts[-1] + self.per, self.starts[-1] * 5 // 4 // self.per * self.per))

    def ranges(self, length: int) -> range:
        """The ranges that the shorter line of a pair can be in; the last one is its own."""
        if length not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[length] = self._ranges(length)
        return self.known[length]

    def _ranges(self, length: int) -> range:
        if length < self.first:
            return range(0)
        least = max(self.first, length * self.per // (self.per + 1) - 1)
        while least + allowed(least, self.edits) < length:
            least += 1
        return range(bisect_right(self.starts, least) - 1, bisect_right(self.starts, length))

    def reach(self, k: int) -> int:
        """The greatest bound of a pair whose shorter line is in the range."""
        return allowed(self.starts[k + 1], self.edits)

    def sizes(self, k: int) -> tuple[int, int]:
        """Characters of a gram, and grams of a stretch. The first line of a range has the shortest run in common."""
        bound = allowed(self.starts[k], self.edits)
        run = -(-(self.starts[k] - bound) // (bound + 1))
        gram = min(GRAM, -(-run // 2))
        return gram, run - gram + 1

    def side(self, k: int) -> int:
        """Characters that lines which share a run also share to the left or to the right of its gram."""
        gram, window = self.sizes(k)
        return min(gram, window // 2)


_STEP = 0x9E3779B97F4A7C15


def _gram_hashes(codes: np.ndarray, gram: int) -> list[tuple[int, np.ndarray]]:
    """Hashes of the 1, 2, 4 and so on up to `gram` numbers from each place on, by doubling; the last places are cut."""
    have, now = 1, (codes + np.uint64(1)) * np.uint64(_STEP)
    now ^= now >> np.uint64(31)
    out = [(have, now)]
    while have < gram:
        more = min(have, gram - have)
        # The second part may overlap the first one; both together are the gram.
        now = now[:-more] * np.uint64((2 * have + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) + now[more:]
        have += more
        out.append((have, now))
    return out


def stretch_minima(texts: list[str], gram: int, window: int, side: int = 0) -> tuple[np.ndarray, ...]:
    """(row, hash, place, marks left and right): of every `window` grams on end those of the least hash, each once.

    A mark tells about the `side` characters next to the gram and is 0 if the
    text has fewer there; without `side` all marks are 1.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < gram + window - 1:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, np.zeros(0, np.int64), none, none
    doubled = _gram_hashes(codes, gram)
    hashes = doubled[-1][1]
    order = ((hashes * np.uint64(_STEP)) >> np.uint64(32)).astype(np.uint32)
    least, have = order, 1
    while have < window:
        more = min(have, window - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    sizes = np.array(list(map(len, texts)))
    ends = np.cumsum(sizes)
    # Stretches that reach into the next text have no least gram; only 0 is below any other one.
    least += least < np.uint32(0xFFFFFFFF)
    for end in ends[:-1].tolist():
        least[max(0, end - gram - window + 2):end] = 0
    # A gram is taken if it is the least of some stretch it lies in: the greatest of their least ones.
    most = np.concatenate([np.zeros(window - 1, np.uint32), least, np.zeros(window - 1, np.uint32)])
    have = 1
    while have < window:
        more = min(have, window - have)
        most = np.maximum(most[:-more], most[more:])
        have += more
    order += order < np.uint32(0xFFFFFFFF)
    at = np.flatnonzero(most == order)
    row = np.searchsorted(ends, at, "right")
    place = at - (ends - sizes)[row]
    return row, _mixed(hashes[at]), place, *_marks(doubled, at, place, sizes[row], gram, side)


def _marks(doubled: list, at: np.ndarray, place: np.ndarray, size: np.ndarray, gram: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the characters left and right of the grams. doubled: as of `_gram_hashes`; at, place: among all texts and in its own."""
    if not side:
        return np.ones(len(at), np.uint64), np.ones(len(at), np.uint64)
    half, hashes = [x for x in doubled if x[0] <= side][-1]

    def mark(start: np.ndarray, there: np.ndarray) -> np.ndarray:
        start = np.where(there, start, 0)
        value = _mixed(hashes[start] * np.uint64(_STEP) + hashes[start + (side - half)]) >> np.uint64(64 - MARK)
        return np.maximum(value, np.uint64(1)) * there

    return mark(at - side, place >= side), mark(at + gram, place + gram + side <= size)


def slotted(key: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray, own: np.ndarray, reach: np.ndarray):
    """Keys that also tell about length and place: (key, row, is index), each once.

    Lines of a pair differ by `reach` at most in both. A line is indexed where
    it is itself; it looks below for its length, and to both sides for the place.
    """
    width, out = 4 * reach, []
    own_n, own_at = size // width, place // width
    for shorter in (0, 1):
        for side in (0, -1, 1):
            n, at = (size - shorter * reach) // width, (place + side * reach) // width
            some = np.flatnonzero(((n != own_n) | (not shorter)) & ((at != own_at) | (not side)))
            slot = _mixed((n[some] * (1 << 32) + at[some]).view(np.uint64) + np.uint64(_STEP))
            out.append((_mixed(key[some] ^ slot), row[some], own[some] & (not shorter and not side)))
    return tuple(map(np.concatenate, zip(*out)))


# ------------------------------------------------------------------ edit distance

def within(first: list[str], second: list[str], edits: int | Growing) -> np.ndarray:
    """For pairs of strings, whether at most as many edits as are allowed make them equal."""
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in zip(first, second)]
    bounds = [allowed(len(b), edits) for _, b in pairs]
    return _measured(pairs, bounds, _alike(pairs, bounds, [i for i, (a, b) in enumerate(pairs) if len(a) - len(b) <= bounds[i]]))


def _measured(pairs: list[tuple[str, str]], bounds: list[int], some: list[int]) -> np.ndarray:
    """Whether each pair (the longer string first) is within its bound; only `some` are tried."""
    good = np.zeros(len(pairs), bool)
    order = sorted(some, key=lambda i: (bounds[i], len(pairs[i][0])))
    start = 0
    while start < len(order):
        stop, bound, longest = start + 1, bounds[order[start]], len(pairs[order[start]][0])
        # Bounds that are little wider share a band.
        while stop < len(order) and bounds[order[stop]] <= min(bound + 2, WIDEST):
            longest = max(longest, len(pairs[order[stop]][0]))
            if (stop + 1 - start) * (longest + 2 * WIDEST) > CELLS:
                break
            stop += 1
        some = order[start:stop]
        # A step of the band over few pairs costs more than the steps of each.
        if stop - start > 12:
            good[some] = _banded([pairs[i][0] for i in some], [pairs[i][1] for i in some], np.array([bounds[i] for i in some]))
        else:
            good[some] = [_wide(*pairs[i], bounds[i]) for i in some]
        start = stop
    return good


def _counts(text: str) -> np.ndarray:
    """Counts of characters in 64 bins, and of pairs of neighbours in 128."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    both = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(25)
    return np.concatenate([np.bincount(codes & 63, minlength=64), np.bincount(both, minlength=128)]).astype(np.int32)


def _alike(pairs: list[tuple[str, str]], bounds: list[int], some: list[int]) -> list[int]:
    """Those of `some` pairs whose counts can be made equal within the bound.

    An edit changes one character, and at most two pairs of neighbours on each side.
    """
    out = []
    for start in range(0, len(some), 4096):
        part = some[start:start + 4096]
        texts = {t: k for k, t in enumerate(dict.fromkeys(t for i in part for t in pairs[i]))}
        counts = np.array([_counts(t) for t in texts], np.int32).reshape(-1, 192)
        more = counts[[texts[pairs[i][0]] for i in part]] - counts[[texts[pairs[i][1]] for i in part]]
        least = [np.maximum(np.maximum(x, 0).sum(axis=1), np.maximum(-x, 0).sum(axis=1)) for x in (more[:, :64], more[:, 64:])]
        needed = np.maximum(least[0], -(-least[1] // 2))
        out += [i for i, n in zip(part, needed.tolist()) if n <= bounds[i]]
    return out


def _wide(long: str, short: str, edits: int) -> bool:
    """The band of `_banded` for one pair, in a number of any size; equal ends are left out first."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (long, short))
    differ = np.flatnonzero(a[:len(b)] != b)
    head = int(differ[0]) if len(differ) else len(b)
    a, b = a[head:], b[head:]
    differ = np.flatnonzero(a[len(a) - len(b):] != b)
    tail = len(b) - 1 - int(differ[-1]) if len(differ) else len(b)
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    band = 2 * edits + 1
    full, top = (1 << band) - 1, 1 << (band - 1)
    rows = {int(c): int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") << edits for c in np.unique(b)}
    score = len(a) - len(b)
    where, up, down = score + edits, full & ~((1 << (edits + 1)) - 1), 0
    for j, c in enumerate(b.tolist()):
        equal = (rows[c] >> j) & full
        up, down = (up >> 1) | top, down >> 1
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up, right_down = down | (~(diagonal | up) & full), diagonal & up
        score += 1 - ((diagonal >> where) & 1)
        if score > edits:
            return False
        right_up = ((right_up << 1) | 1) & full
        up, down = ((right_down << 1) | (~(diagonal | right_up) & full)) & full, diagonal & right_up & full
    return score <= edits


def _codes(texts: list[str], left: int, width: int, fill: int) -> np.ndarray:
    """Code points, a text per row, from column `left` on."""
    out = np.full((len(texts), width), fill, np.uint32)
    for row, t in zip(out, texts):
        row[left:left + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _banded(long: list[str], short: list[str], edits: np.ndarray) -> np.ndarray:
    """The band of 2 * bound + 1 rows around the diagonal, one column at a time; the bound is the greatest of `edits`.

    Bit k of a word stands for row j - bound + k in column j. What lies outside
    of the band counts as one more than its neighbour inside. The result is
    followed on the diagonal that ends in the last cell, where it never falls.
    """
    bound, width = int(edits.max()), max(map(len, long)) + 1
    band, word = 2 * bound + 1, np.uint32 if bound < 16 else np.uint64
    a = _codes(long, bound, width + COLUMNS + 2 * bound, 0xFFFFFFFF).T.copy()
    b = _codes(short, 0, width + COLUMNS, 0xFFFFFFFE).T.copy()
    size = np.array([len(t) for t in short])
    lead = np.array([len(x) for x in long]) - size
    one, full, top = word(1), word((1 << band) - 1), word(1 << (band - 1))
    live = np.arange(len(long))
    score, where = lead.copy(), (lead + bound).astype(word)
    up = np.full(len(long), ((1 << band) - 1) & ~((1 << (bound + 1)) - 1), word)
    down = np.zeros(len(long), word)
    done = np.zeros(len(long), bool)
    for first in range(0, width, COLUMNS):
        keep = (size[live] >= first) & (score <= edits[live])
        if not keep.all():
            live, score, where, up, down = live[keep], score[keep], where[keep], up[keep], down[keep]
            a, b = a[:, keep], b[:, keep]
            if not len(live):
                break
        # Row j - bound + k (from 0) stands in column j + k of the shifted codes.
        every, other = np.zeros((COLUMNS, len(live)), word), b[first:first + COLUMNS]
        for k in range(band):
            every |= (a[first + k:first + k + COLUMNS] == other).astype(word) << word(k)
        ends = set(size[live].tolist())
        for j, equal in enumerate(every, first):
            if j in ends:
                done[live[(size[live] == j) & (score <= edits[live])]] = True
            up = (up >> one) | top
            down = down >> one
            diagonal = (((equal & up) + up) ^ up) | equal | down
            right_up = down | (~(diagonal | up) & full)
            right_down = diagonal & up
            score = score + 1 - ((diagonal >> where) & one).astype(np.int64)
            right_up = ((right_up << one) | one) & full
            up = ((right_down << one) | ~(diagonal | right_up)) & full
            down = diagonal & right_up & full
    return done


# ------------------------------------------------------------------ steps in tasks

def _hashes(line: str) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(line.encode())
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


def _eligible(text: str | None, least: int) -> Iterator[tuple[int, str]]:
    for pos, line in enumerate((text or "").split("\n")):
        line = line.strip(BLANK)
        if len(line) >= least:
            yield pos, line


LINES = "doc_id long, text_key long, pos int, h long, g long"


def _lines(least: int):
    """A row for each line that counts, and one with pos -n and h the characters for a document of n lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch, rows = whole.slice(start, TEXTS), []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    rows.append((i, -1 - (text or "").count("\n"), len(text or ""), None))
                    rows += [(i, pos, *_hashes(line)) for pos, line in _eligible(text, least)]
                at, pos, h, g = zip(*rows)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()),
                     pa.array(h, pa.int64()), pa.array(g, pa.int64())], ["doc_id", "text_key", "pos", "h", "g"])
    return run


def _new_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[tuple[int, str]]]:
    """(hash, line) of the lines a task has not met lately, some texts at a time."""
    met: set[int] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            out = []
            for text in batch.column(0).slice(start, TEXTS).to_pylist():
                for _, line in _eligible(text, least):
                    h = _hashes(line)[0]
                    if h not in met:
                        met.add(h)
                        out.append((h, line))
            if len(met) > REMEMBERED:
                met.clear()
            yield out


def _entries(edits: int | Growing, least: int):
    """(key, line, own, length, place, marks left and right) of some lines, as arrays by kind.

    Length and place are cut at MOST; both are 0 for segments, whose keys tell
    them already, and whose only mark is always the same.
    """
    grams, fewest = _Grams(edits), allowed(0, edits)
    places = _Places(fewest, least, grams.first)
    digest = xxhash.xxh3_64_intdigest

    def short(lines: list[tuple[int, str]]):
        keys, rows, index = [], [], []
        for i, (_, line) in enumerate(lines):
            if len(line) < grams.first + fewest:
                cuts = places(len(line))
                keys += [digest(line[x:y].encode(), n * 64 + k) for k, n, x, y, _ in cuts]
                rows += [i] * len(cuts)
                index += [c[4] for c in cuts]
        zero = np.zeros(len(keys), np.uint64)
        return np.array(keys, np.uint64), np.array(rows, np.int64), np.array(index, bool), zero, zero, zero + np.uint64(1), zero

    def long(lines: list[tuple[int, str]]):
        by: dict[int, list[int]] = {}
        for i, (_, line) in enumerate(lines):
            for k in grams.ranges(len(line)):
                by.setdefault(k, []).append(i)
        for k, at in by.items():
            size = np.array([len(lines[i][1]) for i in at])
            own = np.array([grams.ranges(n)[-1] == k for n in size.tolist()])
            length, at = np.minimum(size, MOST).astype(np.uint64), np.array(at)
            part = np.cumsum(size) // PORTION
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                row, value, place, left, right = stretch_minima([lines[i][1] for i in at[some].tolist()], *grams.sizes(k), grams.side(k))
                row = some[row]
                place = np.minimum(place, MOST).astype(np.uint64)
                yield _mixed(value + np.uint64(k)), at[row], own[row], length[row], place, left, right

    def made(lines: list[tuple[int, str]]) -> Iterator[tuple]:
        yield short(lines)
        yield from long(lines)

    return made


def _packed(edits: int | Growing, least: int, blocks: int):
    """Keys of the lines as (block, bytes): 32 bits of the key, 16 each of length and place, those of the line, one for own, both marks."""
    made, names = _entries(edits, least), np.uint64((1 << NAME) - 1)
    small = np.uint16 if blocks <= 1 << 16 else np.int32

    def entries(key, name, own, length, place, left, right) -> tuple[np.ndarray, np.ndarray]:
        """Block and bytes of each key; only these are held."""
        out = np.empty((len(key), 2), "<u8")
        out[:, 0] = key << np.uint64(32) | length << np.uint64(16) | place
        out[:, 1] = (name << np.uint64(1) | own) << np.uint64(2 * MARK) | left << np.uint64(MARK) | right
        return (((key >> np.uint64(40)) * np.uint64(blocks)) >> np.uint64(24)).astype(small), out

    def flushed(held: list) -> pa.RecordBatch:
        block, out = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(block, kind="stable").astype(np.int32)
        out, block = out.take(order, axis=0), block[order]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(starts, len(block)).astype(np.int32) * WIDTH
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays([pa.array(block[starts].astype(np.int32)), packed], ["block", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        held, count = [], 0
        for fresh in _new_lines(batches, least):
            for start in range(0, len(fresh), 4096):
                lines = fresh[start:start + 4096]
                hashes = np.array([h for h, _ in lines], np.int64).view(np.uint64) & names
                for key, row, *rest in made(lines):
                    if len(key):
                        held.append(entries(key, hashes[row], *rest))
                        count += len(key)
                if count >= PACKED:
                    yield flushed(held)
                    count = 0
        if held:
            yield flushed(held)
    return run


CANDIDATES = "ties long, a long, b long"


#: No line: above the name of any.
NOBODY = np.uint64((1 << 64) - 1)


def _repeats(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it."""
    same_row = np.ones(len(columns[0]), bool)
    same_row[:1] = False
    for c in columns:
        same_row[1:] &= c[1:] == c[:-1]
    return same_row


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all rows of some runs."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + (starts - before).repeat(sizes)


def _bounds(length: np.ndarray, edits: int | Growing) -> np.ndarray:
    return np.maximum(edits.least, length // edits.per) if isinstance(edits, Growing) else np.full(len(length), edits)


def _candidates(edits: int | Growing):
    """Pairs of lines (a, b) that share a key; of keys of many lines their hub (a), each of the others (b) and the number of keys."""
    def fitting(length, place, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether lengths and places differ by no more than the bound; what was cut, or a segment, always fits."""
        bound = _bounds(np.minimum(length[x], length[y]), edits)
        near = (np.abs(length[x] - length[y]) <= bound) & (np.abs(place[x] - place[y]) <= bound)
        return near | (length[x] == 0) | (length[x] == MOST) | (length[y] == MOST)

    def paired(line, own, length, place, marks, starts, sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that fit within each run of entries."""
        for m in np.unique(sizes[sizes > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            heads, step = starts[sizes == m], max(1, MADE // len(i))
            for k in range(0, len(heads), step):
                head = heads[k:k + step][:, None]
                x, y = (head + i).ravel(), (head + j).ravel()
                good = (line[x] != line[y]) & (own[x] | own[y])
                x, y = x[good], y[good]
                good = np.zeros(len(x), bool)
                for mark in marks:
                    good |= (mark[x] == mark[y]) & (mark[x] > 0)
                x, y = x[good], y[good]
                good = fitting(length, place, x, y)
                x, y = line[x[good]], line[y[good]]
                yield np.minimum(x, y), np.maximum(x, y)

    def tied(line, own, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
        """The hub of each run, the least line that owns the key, with every other line of the run."""
        hub = np.minimum.reduceat(np.where(own, line, NOBODY), starts).repeat(sizes)
        other = (hub != line) & (hub != NOBODY)
        return hub[other], line[other]

    def crowded(line, own, length, place, mark, sizes) -> tuple[list, list]:
        """Pairs and ties of keys with a mark of many lines, by length and place where these are known."""
        most = np.maximum.reduceat(length, np.cumsum(sizes) - sizes)
        known, reach = ((0 < most) & (most < MOST)).repeat(sizes), _bounds(most, edits).repeat(sizes)
        key, rows = _mixed(np.arange(1, len(sizes) + 1).astype(np.uint64)).repeat(sizes), np.arange(len(line))
        slots = slotted(*(x[known] for x in (key, rows, place, length, own, reach)))
        key, rows, own = (np.concatenate([x, y[~known]]) for x, y in zip(slots, (key, rows, own)))
        order = np.argsort(key, kind="stable")
        key, rows, own = key[order], rows[order], own[order]
        line, length, place, mark = line[rows], length[rows], place[rows], mark[rows]
        starts, sizes = several(key, line)
        few = sizes <= FEW
        pairs = list(paired(line, own, length, place, [mark], starts[few], sizes[few]))
        order, sizes = _places(starts[~few], sizes[~few]), sizes[~few]
        if not len(order):
            return pairs, []
        return pairs, [tied(line[order], own[order], np.cumsum(sizes) - sizes, sizes)]

    def several(key, line) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the runs of equal keys that have more than one line."""
        starts = np.flatnonzero(~_repeats(key))
        if not len(starts):
            return starts, starts
        sizes = np.diff(np.append(starts, len(key)))
        more = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
        return starts[more], sizes[more]

    def once(tie: bool, pairs: list) -> Iterator[pa.RecordBatch]:
        if pairs:
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*pairs))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            at = np.flatnonzero(~_repeats(a, b))
            ties = pa.array(np.diff(np.append(at, len(a)))) if tie else pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([ties, pa.array(a[at]), pa.array(b[at])], ["ties", "a", "b"])

    def opened(entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Most keys come once; a count by their last bits tells of nearly all of these.
        last = (entries[:, 0] >> np.uint64(32) & np.uint64((1 << min(22, len(entries).bit_length() + 1)) - 1)).astype(np.int64)
        entries = entries[np.bincount(last)[last] > 1]
        entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
        # Lines that several tasks met give equal entries.
        entries = entries[~_repeats(entries[:, 0], entries[:, 1])]
        key, line = entries[:, 0] >> np.uint64(32), entries[:, 1] >> np.uint64(2 * MARK + 1)
        own = (entries[:, 1] >> np.uint64(2 * MARK) & np.uint64(1)).astype(bool)
        length, place = ((entries[:, 0] >> np.uint64(k) & np.uint64(MOST)).astype(np.int64) for k in (16, 0))
        marks = [(entries[:, 1] >> np.uint64(k) & np.uint64((1 << MARK) - 1)).astype(np.int64) for k in (MARK, 0)]
        starts, sizes = several(key, line)
        few = sizes <= FEW
        pairs, ties, held = list(paired(line, own, length, place, marks, starts[few], sizes[few])), [], 0
        # Keys of many lines are told apart by each mark.
        crowd = _places(starts[~few], sizes[~few])
        for mark in marks:
            some = crowd[mark[crowd] > 0]
            some = some[np.lexsort((mark[some], key[some]))]
            starts, sizes = several(key[some] << np.uint64(MARK) | mark[some].view(np.uint64), line[some])
            few = sizes <= FEW
            rest = [x[some] for x in (line, own, length, place)]
            pairs += paired(*rest, [mark[some]], starts[few], sizes[few])
            starts, sizes = starts[~few], sizes[~few]
            for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(np.cumsum(sizes) // CROWDED)) + 1) if len(starts) else []:
                here = _places(starts[part], sizes[part])
                more, hubs = crowded(*(x[here] for x in rest), mark[some[here]], sizes[part])
                pairs += more
                ties += hubs
                held += sum(len(a) for a, _ in more + hubs)
                if held > MADE:
                    yield from once(False, pairs)
                    yield from once(True, ties)
                    pairs, ties, held = [], [], 0
        yield from once(False, pairs)
        yield from once(True, ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in _then_none(batches):
            for row in zip(batch.column(0).to_pylist(), batch.column(1)) if batch is not None else [(None, None)]:
                if held and row[0] != block:
                    yield from opened(np.concatenate(held))
                    held = []
                if row[1] is not None:
                    block = row[0]
                    held.append(np.frombuffer(row[1].as_buffer(), "<u8").reshape(-1, 2))
    return run


def _bit_set(table: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of some hashes are set in a table of `_bits_of`."""
    bit = hashes & (BITS - 1)
    return (np.frombuffer(table, np.uint8)[bit >> 3] >> (bit & 7) & 1).astype(bool)


def _some_lines(wanted, least: int):
    """(h, line) of the lines whose bit is set, most of them once; wanted: the broadcast bit table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for lines in _new_lines(batches, least):
            hashes = np.array([h for h, _ in lines], np.int64)
            here = np.flatnonzero(_bit_set(wanted.value, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[here]), pa.array([lines[i][1] for i in here.tolist()], pa.string())], ["h", "line"])
    return run


def _rows_with(wanted, bit: bool):
    """The rows of lines whose bit is set, or of those whose bit is not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_bit_set(wanted.value, batch.column(3).to_numpy()) == bit))
    return run


PAIRS = "a long, b long"


def _verified(edits: int | Growing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], ["a", "b"])
    return run


def _across(edits: int | Growing):
    """Near pairs of different classes within each run of equal g; rows come sorted by g.

    Rows: g, side, h, class, hub, all hubs of the line, line. A pair is compared
    under the least hub of both only, and not at all if near pairs found before
    in the task connect its classes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        held: list = []
        # Classes that near pairs of this task connect.
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def compared(rows: list) -> Iterator[tuple[int, int]]:
            rows.sort(key=lambda r: r[1])
            first = sum(not r[1] for r in rows)
            two = first < len(rows)
            classes = np.array([top(r[3]) for r in rows], np.int64)
            texts = [r[6] for r in rows]
            counts, size = np.array([_counts(t) for t in texts], np.int32), np.array(list(map(len, texts)))
            # Hubs below this one: who shares such a one is compared there.
            below = {hub: k for k, hub in enumerate({hub for r in rows for hub in r[5] if hub < r[4]})}
            has = np.zeros((len(rows), len(below)), np.float32)
            for k, r in enumerate(rows):
                has[k, [below[hub] for hub in r[5] if hub in below]] = 1
            found: list[tuple] = []
            for i in range(first):
                others = np.arange(first if two else i + 1, len(rows))
                others = others[classes[others] != classes[i]]
                bound = _bounds(np.minimum(size[others], size[i]), edits)
                here = (np.abs(size[others] - size[i]) <= bound) & (has[others] @ has[i] == 0)
                others, bound = others[here], bound[here]
                both = np.minimum(counts[others], counts[i])
                most = np.maximum(size[others], size[i])
                # As in `_alike`: what is not in common, of characters and of pairs of neighbours.
                needed = np.maximum(most - both[:, :64].sum(axis=1), -(-(most - 1 - both[:, 64:].sum(axis=1)) // 2))
                good = needed <= bound
                found.append((np.full(good.sum(), i), others[good], bound[good], needed[good]))
            if not found:
                return
            x, y, bound, needed = map(np.concatenate, zip(*found))
            order = np.argsort(needed - bound, kind="stable")
            x, y, bound, step = x[order], y[order], bound[order], 256
            # The likeliest first: near ones save the others of their classes.
            while len(x):
                some = [(texts[i], texts[k]) if size[i] >= size[k] else (texts[k], texts[i]) for i, k in zip(x[:step].tolist(), y[:step].tolist())]
                good = _measured(some, bound[:step].tolist(), list(range(len(some))))
                for i, k in zip(x[:step][good].tolist(), y[:step][good].tolist()):
                    if classes[i] != classes[k]:
                        yield rows[i][2], rows[k][2]
                        root[int(classes[k])] = int(classes[i])
                        classes[classes == classes[k]] = classes[i]
                x, y, bound, step = x[step:], y[step:], bound[step:], min(2 * step, ASKED)
                left = classes[x] != classes[y]
                x, y, bound = x[left], y[left], bound[left]
            if len(root) > CLASSES:
                root.clear()

        for batch in _then_none(batches):
            found: list[tuple[int, int]] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))) if batch is not None else [(None,)]:
                if held and held[0][0] != row[0]:
                    found += compared(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    return run


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


# ------------------------------------------------------------------ the join

def _name(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << NAME) - 1).cast("long"))


def _bits_of(hashes: DataFrame, name: str):
    """The bit table of some hashes of lines, or of their names, sent to all tasks: it proves that a line is not among them."""
    return hashes.sparkSession.sparkContext.broadcast(bit_table(hashes, F.col(name).bitwiseAND(F.lit(BITS - 1).cast("long")).cast("int")))


def _line_texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """n, h, line of the lines whose names are wanted; a few others may be among them.

    Documents stay where they are: the lines of each whose bit is set are sent.
    """
    texts = docs.select("text").mapInArrow(_some_lines(_bits_of(wanted, "n"), least), "h long, line string")
    # A task sends a line once mostly, so nothing is gained by sorting its lines before they are dealt.
    texts = texts.repartition("h").groupBy("h").agg(F.first("line").alias("line"))
    return stored(texts.withColumn("n", _name(F.col("h"))), "line-texts")


def near_lines(docs: DataFrame, characters: int, edits: int | Growing = EDITS, least: int = LEAST) -> DataFrame:
    """Classes of different lines that are near: node, root (hashes of lines).

    docs: text (further columns are not read). The number of blocks of keys
    follows the characters of the texts.
    """
    blocks = min(1 << 24, max(64, -(-characters // CHARACTERS)))
    packed = docs.select("text").mapInArrow(_packed(edits, least, blocks), "block int, entries binary")
    found = packed.repartition("block").sortWithinPartitions("block").mapInArrow(_candidates(edits), CANDIDATES)
    found = stored(found, "line-candidates")
    pairs = found.groupBy("a", "b").agg(F.sum("ties").alias("ties"), F.max(F.isnull("ties")).alias("plain"))
    pairs = stored(pairs, "line-pairs")
    forget(found)
    asked, ties = pairs.where("plain").select("a", "b"), pairs.where("ties > 0").select(F.col("a").alias("hub"), F.col("b").alias("n"), "ties")
    crowds = None
    if not ties.isEmpty():
        hubs = ties.groupBy("hub").agg(F.max("ties").alias("ties")).select("hub", F.col("hub").alias("n"), "ties")
        crowds = stored(ties.unionByName(hubs), "line-crowds")
        asked = asked.unionByName(_tied(crowds)).distinct()
    asked = stored(asked, "line-asked")
    forget(pairs)
    wanted = asked.select(F.col("a").alias("n")).unionByName(asked.select(F.col("b").alias("n")))
    lines = _line_texts(docs, wanted, least)
    near = components(stored(_checked(asked, lines, edits), "line-links"))
    forget(asked)
    if crowds is not None:
        near = stored(near, "line-comp")
        more = _near_in_crowds(crowds, lines, near, edits)
        near = components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    forget(lines)
    return near


def _tied(crowds: DataFrame) -> DataFrame:
    """Pairs (a, b): the line of each hub that shares most keys of many lines, with every other one of the hub."""
    keys = crowds.groupBy("n").agg(F.sum("ties").alias("keys"))
    among = crowds.select("hub", "n").join(keys, "n")
    middle = among.groupBy("hub").agg(F.max(F.struct("keys", "n")).alias("most")).select("hub", F.col("most.n").alias("a"))
    pairs = crowds.select("hub", F.col("n").alias("b")).join(middle, "hub").where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _checked(pairs: DataFrame, lines: DataFrame, edits: int | Growing) -> DataFrame:
    """The pairs (a, b) of lines that are near, as hashes. pairs: a, b, names of lines."""
    side = lambda k, h, x: lines.select(F.col("n").alias(k), F.col("h").alias(h), F.col("line").alias(x))
    both = pairs.join(side("b", "hb", "y"), "b").join(side("a", "ha", "x"), "a")
    return both.select("ha", "hb", "x", "y").mapInArrow(_verified(edits), PAIRS)


def _near_in_crowds(crowds: DataFrame, lines: DataFrame, comp: DataFrame, edits: int | Growing) -> DataFrame:
    """Further near pairs of lines that share a key with many others.

    crowds: hub, n (names); comp: the classes found so far (node, root). Lines of a hub
    that are still in different classes are compared with each other, block by block.
    """
    named = lines.join(comp.withColumnRenamed("node", "h"), "h", "left").select(
        "n", "h", F.coalesce("root", "h").alias("comp"), F.length("line").alias("size"))
    placed = stored(crowds.join(named, "n").select("hub", "h", "comp", "size"), "line-placed")
    split = placed.groupBy("hub").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    n_blocks = F.ceil(F.greatest(F.col("n") / float(BLOCK), F.col("size") / float(CHARACTERS)))
    split = stored(split.where("low != high").select("hub", n_blocks.alias("n_blocks")), "line-open")
    still = stored(placed.join(split, "hub").select("hub", "h", "comp", "n_blocks"), "line-still")
    every = still.groupBy("h").agg(F.collect_set("hub").alias("hubs"))
    rows = still.join(every, "h").join(lines.select("h", "line"), "h")
    block = F.pmod(F.xxhash64("h"), F.col("n_blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low != high, (F.col("block") == high).cast("int")).otherwise(0)
    rows = rows.select(F.xxhash64("hub", low, high).alias("g"), side.alias("side"), "h", "comp", "hub", "hubs", "line")
    # As many tasks as there may be: comparing takes long, reading does not.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_across(edits), PAIRS)
    return stored(more.distinct(), "line-more")


def _place() -> Column:
    """Order of documents and lines; a missing id comes last."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)"))
    return (doc * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")


def repeated_lines(docs: DataFrame, edits: int | Growing = EDITS, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, text_key, n_lines, dropped (sorted line numbers from 0).

    docs: doc_id, text (further columns are not read). A line counts with at
    least `least` characters, without the blanks around it. Of every class of
    lines, linked by at most `edits` edits (a number, or one that grows with the
    shorter line), the one with the smallest (doc_id,
    number) stays; null ids come last. Rows that repeat an id are one document
    in this order: where they hold the same line in the same place, it stays in
    each. A null text has one empty line and drops none. text_key is xxhash64
    of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_lines(least), LINES), "lines")
    characters = rows.where("pos < 0").agg(F.sum("h")).first()[0] or 0
    near = stored(near_lines(docs, characters, edits, least), "line-classes")
    # Most lines are near no other one; only the others are joined.
    bits, own = _bits_of(near, "node"), rows.where("pos >= 0")
    joined = own.mapInArrow(_rows_with(bits, True), LINES).join(near.withColumnRenamed("node", "h"), "h", "left")
    every = joined.select("doc_id", "text_key", "pos", F.coalesce("root", "h").alias("c"),
                          F.when(F.col("root").isNull(), F.col("g")).otherwise(0).alias("g")).unionByName(
        own.mapInArrow(_rows_with(bits, False), LINES).select("doc_id", "text_key", "pos", F.col("h").alias("c"), "g"))
    named = stored(every.withColumn("place", _place()), "lines-named")
    firsts = named.groupBy("c", "g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.where("n > 1").drop("n"), "line-firsts")
    again = named.join(firsts, ["c", "g"]).where("place > first")
    again = again.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    every = rows.where("pos < 0").select("doc_id", "text_key", (-F.col("pos")).cast("long").alias("n_lines"))
    joined = every.alias("e").join(stored(again, "line-dropped").alias("a"), same("e", "a", "doc_id", "text_key"), "left")
    return joined.select("e.doc_id", "e.text_key", "e.n_lines",
                         F.coalesce("a.dropped", F.array().cast("array<int>")).alias("dropped"))


@F.pandas_udf(StringType())
def _without(text: pd.Series, dropped: pd.Series) -> pd.Series:
    def cut(t: str, drop) -> str:
        gone = set(drop.tolist())
        return "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone)
    return pd.Series([t if d is None or t is None else cut(t, d) for t, d in zip(text, dropped)])


def without_repeats(docs: DataFrame, edits: int | Growing = EDITS, least: int = LEAST) -> DataFrame:
    """The documents without the repeated lines, all columns.

    A document of which nothing but blanks is left after lines were taken goes
    altogether; one that was empty before stays.
    """
    found = repeated_lines(docs, edits, least).where(F.size("dropped") > 0).select("doc_id", "text_key", "dropped").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    joined = keyed.alias("d").join(stored(found, "line-cuts").alias("f"), same("d", "f", "doc_id", "text_key"), "left")
    cut = joined.select("d.row", F.col("f.dropped").isNotNull().alias("cut"),
                        F.when(F.col("f.dropped").isNotNull(), _without(F.col("d.row.text"), F.col("f.dropped")))
                        .otherwise(F.col("d.row.text")).alias("text"))
    left = cut.where(~F.col("cut") | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
