"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A signature has SYMBOLS symbols of 16 bits; the distance of two signatures is
the number of symbols that differ. With at most `distance` differing symbols and
so many chunks that twice their number is more, some chunk has at most one error. So
every chunk is indexed with each of its symbols left out in turn: two
signatures within the distance share at least one such key, always.

The distance follows from the similarity bound: documents at the bound are within
it but for fewer than RISK (a binomial tail), more similar ones far more surely.

Only classes of documents with equal shingle sets are compared. Signatures
within the distance connect classes to families, and the full sets of a family
are compared block by block in the tasks, so that no list of pairs is ever
made: what leaves a task are the links that connect its classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import same, stored
from logrisk.llm.graph import components

SHINGLE = 5
SYMBOLS = 64
#: Classes of one block when those of a key (signatures) or of a family (sets) are compared.
KEY_BLOCK, BLOCK = 1_024, 128
#: Shingles of one product of membership columns.
COLUMNS = 8_192
#: Similar when bound[0] * intersection >= bound[1] * union; BOUND is the one of op10.
BOUND = (100, 85)
#: Share of the pairs at the bound whose signatures may differ more than the distance.
RISK = 5e-4

#: Bits of the table that tells which documents are wanted again, and those packed together.
BITS, CHUNK_BITS = 1 << 26, 1 << 16

_mask = (1 << 64) - 1
_random = np.random.default_rng(20_240_229)
_odd = lambda n: _random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES, _BASE = _odd(256), int(_odd(1)[0])
_PLACE, _SHORT = _odd(SHINGLE), _odd(1)[0]
_SEED, _FACTOR = _odd(SYMBOLS)[:, None], _odd(SYMBOLS)[:, None]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.full(65_536, _BASE, np.uint64)
_powers[0] = 1
_powers = np.cumprod(_powers, dtype=np.uint64)


def _power(i: np.ndarray) -> np.ndarray:
    out = _powers[i & 65_535]
    if len(i) and i.max() > 65_535:
        top = pow(_BASE, 65_536, 1 << 64)
        high = np.array([pow(top, k, 1 << 64) for k in range(int(i.max() >> 16) + 1)], np.uint64)
        out = out * high[i >> 16]
    return out


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, A-Z as a-z, in order."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    inside = ~_BLANK[raw]
    letters = raw[inside]
    if not len(letters):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    new = np.concatenate([[True], np.diff(at) > 1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.concatenate([starts, [len(letters)]]))
    within = np.arange(len(letters)) - np.repeat(starts, lengths)
    return _mixed(np.add.reduceat(_BYTES[letters] * _power(within), starts) + lengths.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: sorted different hashes of 5 words, or of all words if fewer."""
    words = word_hashes(text or "")
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        total = words[:n] * _PLACE[0]
        for k in range(1, SHINGLE):
            total += words[k:n + k] * _PLACE[k]
        return np.unique(_mixed(total))
    if not len(words):
        return words
    return _mixed(np.sum(words * _PLACE[:len(words)], keepdims=True) + _SHORT * np.full(1, len(words), np.uint64))


def signature(values: np.ndarray) -> bytes:
    """SYMBOLS symbols of 16 bits, as bytes."""
    least = np.full(SYMBOLS, _mask, np.uint64)
    for k in range(0, len(values), 4096):
        x = (values[None, k:k + 4096] ^ _SEED) * _FACTOR
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    return _mixed(least).astype("<u2").tobytes()


def fingerprint(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def distance_of(bound: tuple[int, int]) -> int:
    """The least distance that pairs at the bound exceed in fewer than RISK of the cases."""
    differ = 1 - bound[1] / bound[0]
    chance = [math.comb(SYMBOLS, k) * differ ** k * (1 - differ) ** (SYMBOLS - k) for k in range(SYMBOLS + 1)]
    return next(d for d in range(SYMBOLS + 1) if sum(chance[d + 1:]) < RISK)


DISTANCE = distance_of(BOUND)


@lru_cache
def _plan(distance: int) -> list[tuple[list[int], np.ndarray]]:
    """Symbols and weights of every key: each chunk with each of its symbols left out."""
    chunks = [c.tolist() for c in np.array_split(np.arange(SYMBOLS), distance // 2 + 1)]
    rng = np.random.default_rng(distance)
    keys = [[i for i in c if i != left] for c in chunks for left in c]
    return [(k, rng.integers(0, 1 << 63, len(k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)) for k in keys]


def signature_keys(signatures: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Keys of each signature, a column for each way to leave out a symbol of a chunk."""
    wide, plan = signatures.astype(np.uint64) + np.uint64(1), _plan(distance)
    out = np.empty((len(wide), len(plan)), np.uint64)
    for k, (symbols, weights) in enumerate(plan):
        out[:, k] = _mixed((wide[:, symbols] * weights).sum(axis=1, dtype=np.uint64) + np.uint64(k))
    return out.view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


# ------------------------------------------------------------------ steps in tasks

def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            values = shingles(text)
            rows.append((len(values), fingerprint(values), signature(values)) if len(values) else (0, None, None))
        n, fp, sig = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
            ["doc_id", "n_shingles", "fp", "sig"])


def _sets(wanted):
    """Fingerprints and sets of the documents whose bit is set; wanted: the broadcast bit table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            bit = batch.column(1).to_numpy()
            here = np.flatnonzero(table[bit >> 3] >> (bit & 7) & 1)
            part = batch.take(pa.array(here))
            sets = [shingles(text) for text in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(fingerprint, sets), pa.binary()),
                 pa.array([v.tobytes() for v in sets], pa.binary())], ["doc_id", "fp", "values"])
    return run


def _keyed(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                keys = signature_keys(_signatures(part.column(1)), distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], ["key", "node"])
    return run


def _near(distance: int):
    """Of pairs with both signatures, those within the distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _signatures(batch.column(2)), _signatures(batch.column(3))
            near = (a != b).sum(axis=1) <= distance
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])
    return run


def _linked(bound: tuple[int, int]):
    """Links within each run of equal g, from full sets, as (node, a smaller node it is connected with)."""
    def links(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        node = np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        size = np.array([len(v) for v in sets])
        both = intersections(sets)
        similar = bound[0] * both >= bound[1] * (size[:, None] + size - both)
        x, y = np.nonzero(np.triu(similar, 1))
        lowest, before = node.copy(), None
        while before is None or (lowest != before).any():
            before = lowest.copy()
            np.minimum.at(lowest, x, before[y])
            np.minimum.at(lowest, y, before[x])
        some = lowest != node
        yield pa.RecordBatch.from_arrays([pa.array(lowest[some]), pa.array(node[some])], ["a", "b"])

    return lambda batches: _runs(batches, links)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of membership columns."""
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    value, owner = np.concatenate(sets)[order], owner[order]
    column = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
    # What only one set holds is in no intersection of two.
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[False], np.diff(column) > 0])) if len(column) else column
    out = np.zeros((len(sets),) * 2)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, (start, start + COLUMNS)))
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[owner[at], column[at] - start] = 1
        out += member @ member.T
    np.fill_diagonal(out, [len(v) for v in sets])
    return out


def _runs(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """Calls `use` with the rows of each run of equal first columns; rows come sorted by it."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield from use(held)
                held = []
            held.append(row)
    yield from use(held)


def _across(distance: int):
    """Near rows within each run of equal g, as (node, a smaller node it is connected with)."""
    def links(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        node = np.array([r[2] for r in rows])
        sig = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(-1, SYMBOLS)
        lowest, before = node.copy(), None
        near = [np.flatnonzero((sig != one).sum(axis=1) <= distance) for one in sig]
        while before is None or (lowest != before).any():
            before = lowest.copy()
            lowest = np.array([before[at].min() for at in near])
        some = lowest != node
        yield pa.RecordBatch.from_arrays([pa.array(lowest[some]), pa.array(node[some])], ["a", "b"])

    return lambda batches: _runs(batches, links)


# ------------------------------------------------------------------ the join

PAIRS = "a long, b long"


def near_pairs(pairs: DataFrame, sigs: DataFrame, distance: int) -> DataFrame:
    """Pairs of nodes within the distance. pairs: a, b; sigs: node, sig."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a") \
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_near(distance), PAIRS)


def _blocks(rows: DataFrame, group: str, value: str, size: int) -> DataFrame:
    """Rows of every group dealt to pairs of blocks, sorted: g, side, node, value.

    `n` holds the rows of the group. Each row goes to as many places as its
    group has blocks, so a large group is many tasks.
    """
    blocks = F.ceil(F.col("n") / F.lit(float(size))).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = rows.select(F.xxhash64(group, low, high).alias("g"), (F.col("block") == high).cast("int").alias("side"), "node", value)
    return dealt.repartition("g").sortWithinPartitions("g")


def families(classes: DataFrame, distance: int) -> DataFrame:
    """Classes that are connected by signatures within the distance: node, root, for families of two or more.

    Each key first ties its classes to one of them; only keys whose classes
    are then still in several families have all of theirs compared.
    """
    keys = classes.select("node", "sig").mapInArrow(_keyed(distance), "key long, node long")
    hubs = stored(keys.groupBy("key").agg(
        F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-hubs")
    members = stored(
        keys.join(hubs.where("n > 2"), "key").select("key", "node", "hub", "n"), "minhash-members")
    first = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(
        hubs.where("n = 2").select(F.col("hub").alias("a"), F.col("last").alias("b"))).distinct()
    sigs = classes.select("node", "sig")
    near = stored(near_pairs(first, sigs, distance), "minhash-near")
    comp = stored(components(near), "minhash-comp")
    placed = stored(members.join(comp, "node", "left").select(
        "key", "node", "n", F.coalesce("root", "node").alias("comp")), "minhash-placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")) \
        .where("low != high").select("key")
    rows = placed.join(stored(split, "minhash-open"), "key").join(sigs, "node").select("key", "node", "n", "sig")
    more = _blocks(rows, "key", "sig", KEY_BLOCK).mapInArrow(_across(distance), PAIRS)
    return components(near.unionByName(more))


def _bit() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("int")


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    table = np.zeros(CHUNK_BITS, bool)
    table[rows["bit"].to_numpy() % CHUNK_BITS] = True
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "bits": [np.packbits(table, bitorder="little").tobytes()]})


def bit_table(rows: DataFrame, bit: Column | None = None) -> bytes:
    """BITS bits, set where the hash of a doc_id (or `bit`) falls: 8 MB, however many rows.

    A set bit may belong to other documents too, so a join has to follow; an
    unset one proves that a document is not among the rows.
    """
    bits = rows.select((_bit() if bit is None else bit).alias("bit")).distinct().withColumn("chunk", F.floor(F.col("bit") / CHUNK_BITS).cast("int"))
    table = bytearray(BITS // 8)
    for r in bits.groupBy("chunk").applyInPandas(_packed, "chunk int, bits binary").collect():
        table[r.chunk * CHUNK_BITS // 8:(r.chunk + 1) * CHUNK_BITS // 8] = r.bits
    return bytes(table)


def links(classes: DataFrame, docs: DataFrame, bound: tuple[int, int]) -> DataFrame:
    """Links (a, b) that connect the similar classes, confirmed on full sets.

    classes: node, fp, sig, doc_id; docs: doc_id, text. All classes of a family
    are compared, block by block, on sets made anew from their texts; what
    comes out are the links that connect them, not all pairs.
    """
    family = stored(families(classes, distance_of(bound)), "minhash-families")
    wanted = stored(family.select("node").join(classes, "node").select("node", "fp", "doc_id"), "minhash-wanted")
    # Texts of other documents stay where they are: a bit table of fixed size tells them apart.
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(wanted))
    sets = docs.select("doc_id", _bit().alias("bit"), "text").mapInArrow(
        _sets(bits), "doc_id long, fp binary, values binary")
    sets = sets.alias("s").join(wanted.alias("w"), same("s", "w", "doc_id") & (F.col("s.fp") == F.col("w.fp")))
    # A class may be found in several equal rows.
    sets = stored(sets.groupBy("w.node").agg(F.first("s.values").alias("values")), "minhash-sets")
    sizes = stored(family.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "minhash-family-sizes")
    rows = sets.join(family.join(sizes, "root"), "node").select("root", "node", "n", "values")
    return _blocks(rows, "root", "values", BLOCK).mapInArrow(_linked(bound), PAIRS)


def _rooted(docs: DataFrame, bound: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Rows with words (doc_id, text_key, n_shingles, root, component_id), and rows without (the first three)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("k"), "text").mapInArrow(
        _described, "k struct<doc_id:bigint,text_key:bigint>, n_shingles long, fp binary, sig binary")
    rows = stored(rows.select("k.*", "n_shingles", "fp", "sig"), "minhash-rows")
    classes = rows.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    comp = components(links(classes, docs, bound))
    named = classes.join(comp, "node", "left").select(
        "fp", "doc_id", F.coalesce("root", "node").alias("root"))
    named = stored(named, "minhash-named")
    least = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "minhash-least")
    of_class = stored(named.join(least, "root").select("fp", "root", "component_id"), "minhash-of-class")
    found = rows.where("fp is not null").join(of_class, "fp").select("doc_id", "text_key", "n_shingles", "root", "component_id")
    return found, rows.where("fp is null").select("doc_id", "text_key", "n_shingles")


def near_duplicates(docs: DataFrame, bound: tuple[int, int] = BOUND) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept.

    docs: doc_id, text (further columns are not read). component_id is the
    smallest doc_id reachable by links, which join texts whose sets are similar by
    `bound`; a text without words has none but its
    own. Repeated rows belong together and all have kept where the id is the
    component's. Null ids count last: components of null ids alone have a null
    component_id and are kept. text_key is xxhash64 of the text.
    """
    found, bare = _rooted(docs, bound)
    every = found.drop("root").unionByName(bare.withColumn("component_id", F.col("doc_id")))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, bound: tuple[int, int] = BOUND) -> DataFrame:
    """The documents that stay, all columns: of each component one row.

    It is the row with the smallest doc_id (null last), then the smallest hash
    of the text; of rows that repeat both, one. Documents without words are
    near nothing and all stay. An empty table gives no rows.
    """
    found, _ = _rooted(docs, bound)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    kept = stored(found.groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.text_key"), "minhash-kept")
    text = F.col("text").cast("string")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64(text).alias("text_key"), F.coalesce(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("words"))
    chosen = named.where("words").alias("d").join(kept.alias("k"), same("d", "k", "doc_id", "text_key"), "left_semi")
    return chosen.dropDuplicates(["doc_id", "text_key"]).unionByName(named.where(~F.col("words"))).select("row.*")
