"""Near-duplicate vectors by binary codes with error bounds.

A vector is turned by a random rotation into at least 256 dimensions, and its
signs are its code, which is stored once with a factor (the product of the code
with its own vector). The inner product of a rotated vector with the code of
another one, divided by the factor of the code, is an unbiased estimate of the
cosine; the factor also gives how far the estimate is off at most, at
CONFIDENCE deviations. Estimates read the stored codes and a copy of the other
vector in one byte a component, whose own error is stored and added to the
bound. Exact vectors are fetched only for vectors of undecided pairs, those
whose upper bound reaches the threshold, and these pairs are computed exactly.

The pairs to estimate come from tables of cells: a cell is a label and the
signs of some random directions, drawn anew for every table. The number of
directions follows the vectors of the label, about CELL in a cell, and the
number of tables follows the directions, so that a pair right at the threshold
meets in some table with probability RECALL, closer pairs far more surely. A
pair counts in the first table where it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import same, stored
from logrisk.llm.graph import components

DIMENSIONS = 256
CELL = 512
BLOCK = 1024
CONFIDENCE = 5.0
RECALL = 0.999
SEED = 11


def tables(count: int, threshold: float) -> tuple[int, int]:
    """(bits of a cell, number of tables) for a label with so many vectors."""
    bits = max(0, ceil(log2(max(count, 1) / CELL)))
    meet = (1 - acos(min(1.0, max(-1.0, threshold))) / pi) ** bits
    return bits, 1 if meet >= RECALL else ceil(log(1 - RECALL) / log(1 - meet))


@lru_cache(4)
def rotation(size: int) -> np.ndarray:
    """Columns that are orthonormal, one per dimension of the vectors."""
    wide = max(DIMENSIONS, -(-size // 8) * 8)
    return np.linalg.qr(np.random.default_rng([SEED, size]).standard_normal((wide, size)))[0]


@lru_cache(512)
def directions(table: int, bits: int, size: int) -> np.ndarray:
    """Random directions of a table of cells, one per column."""
    return np.random.default_rng([SEED, table, bits, size]).standard_normal((size, bits))


def cell_codes(unit: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The packed signs of unit vectors in a table."""
    return np.packbits(unit @ directions(table, bits, unit.shape[1]) > 0, axis=1)


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0 or 1 per dimension) and factors of unit vectors."""
    turned = unit @ rotation(unit.shape[1]).T
    return (turned > 0).astype(np.uint8), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def rough(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in a byte a component, what a step is worth, and the length of the error."""
    step = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / step[:, None]).astype(np.int8)
    return values, step, np.sqrt(((unit - values * step[:, None]) ** 2).sum(axis=1))


def estimate(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (coded row, query column), and how far each row's may be off."""
    wide = codes.shape[1]
    turned = (queries @ rotation(queries.shape[1]).T).astype(np.float32)
    signs = codes.astype(np.float32) * 2 - 1
    value = signs @ turned.T / np.float32(np.sqrt(wide)) / factors[:, None].astype(np.float32)
    error = CONFIDENCE * np.sqrt(np.maximum(0, 1 - factors ** 2)) / factors / np.sqrt(wide - 1)
    return value, error


# ------------------------------------------------------------------ steps in tasks

def _unit(values) -> np.ndarray | None:
    if values is None or not len(values) or None in values:
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_unit(v) if label is not None else None
                 for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
        raw = [None if u is None else u.tobytes() for u in units]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([None if u is None else len(u) for u in units], pa.int32()),
             pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()),
             pa.array(raw, pa.binary())], ["vec_id", "label", "size", "fp", "unit"])


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _celled(threshold: float):
    """A row for every table of a vector: cell, node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, size, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            raw, node = batch.column(4), batch.column(0).to_numpy()
            for group in sorted(set(zip(label.tolist(), size.tolist(), count.tolist()))):
                here = np.flatnonzero((label == group[0]) & (size == group[1]) & (count == group[2]))
                unit = _matrix(raw.take(pa.array(here)))
                bits, times = tables(group[2], threshold)
                for t in range(times):
                    part = cell_codes(unit, t, bits)
                    name = f"{group[0]},{group[1]},{t},{bits},".encode()
                    cells = [xxhash.xxh3_64_intdigest(name + p.tobytes()) for p in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(cells, np.uint64).view(np.int64)), pa.array(node[here]),
                         pa.array(np.full(len(here), t, np.int32)), pa.array(np.full(len(here), bits, np.int32))],
                        ["cell", "node", "t", "bits"])
    return run


CODES = "code binary, factor double, rough binary, step double, error double"


def _with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, copies and the stored codes of each class; the exact vector stays behind."""
    for batch in batches:
        sizes = batch.column(3).to_numpy(zero_copy_only=False)
        for size in sorted(set(sizes.tolist())):
            part = batch.filter(pa.array(sizes == size))
            unit = _matrix(part.column(2))
            codes, factors = coded(unit)
            values, step, error = rough(unit)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([c.tobytes() for c in np.packbits(codes, axis=1)], pa.binary()),
                 pa.array(factors), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(step), pa.array(error)],
                ["node", "copies", "code", "factor", "rough", "step", "error"])


def _runs(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """work(rows) of each run of equal values in the first column."""
    held: list = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if held and held[0][0] != row[0]:
                yield from work(held)
                held = []
            held.append(row)
    yield from work(held)


def _undecided(rows: list, at: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that the codes cannot rule out. rows: g, side, ..., and from `at` on CODES."""
    side = np.array([r[1] for r in rows])
    # A block with itself has side -1.
    two = side[0] >= 0
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(rows)),) * 2
    if not len(left) or not len(right):
        return left[:0], left[:0]
    codes = np.unpackbits(np.frombuffer(b"".join(r[at] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    factor, step, error = (np.array([r[at + k] for r in rows]) for k in (1, 3, 4))
    values = np.frombuffer(b"".join(r[at + 2] for r in rows), np.int8).reshape(len(rows), -1) * step[:, None]
    value, off = estimate(codes[left], factor[left], values[right])
    maybe = value + off[:, None] + error[right] >= threshold
    if not two:
        maybe = np.triu(maybe, 1) | np.triu(maybe.T, 1)
    x, y = np.nonzero(maybe)
    return left[x], right[y]


def _opened(threshold: float):
    """(g, node) of the vectors of a block that are in an undecided pair."""
    def work(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            places = np.unique(np.concatenate(_undecided(rows, 3, threshold)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[0][0]] * len(places), pa.int64()), pa.array([rows[p][2] for p in places], pa.int64())], ["g", "node"])

    return lambda batches: _runs(batches, work)


FOUND = "node long, links long, other long"


def _compared(threshold: float):
    """Per block, for each vector the linked copies of others and one node it is connected with."""
    def work(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        t, bits = rows[0][2], rows[0][3]
        node, copies = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        unit = np.frombuffer(b"".join(r[6] for r in rows), np.float64).reshape(len(rows), -1)
        earlier = [cell_codes(unit, k, bits) for k in range(t)]
        x, y = _undecided(rows, 7, threshold)
        good = np.zeros(len(x), bool)
        for k in range(0, len(x), 65_536):
            some = slice(k, k + 65_536)
            close = np.einsum("ij,ij->i", unit[x[some]], unit[y[some]]) >= threshold
            for cells in earlier:
                close &= (cells[x[some]] != cells[y[some]]).any(axis=1)
            good[some] = close
        x, y = x[good], y[good]
        if not len(x):
            return
        linked = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
        lowest, before = node.copy(), None
        while before is None or (lowest != before).any():
            before = lowest.copy()
            np.minimum.at(lowest, x, before[y])
            np.minimum.at(lowest, y, before[x])
        some = linked > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[some]), pa.array(linked[some].astype(np.int64)), pa.array(lowest[some])],
            ["node", "links", "other"])

    return lambda batches: _runs(batches, work)


# ------------------------------------------------------------------ the join

def near_vectors(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    rows: vec_id, embedding, label (further columns are not read). Vectors of
    one label and length link at a cosine of `threshold` or more. Vectors that
    are null, empty or zero, hold null or non-finite numbers, or have no label,
    link with nothing. Equal vectors are one class from the start; their links
    are counted, not listed. Null ids come last: a component of null ids alone
    has a null id. Repeated rows link with each other as any others.
    """
    rows = stored(rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).mapInArrow(_described, "vec_id long, label string, size int, fp binary, unit binary"), "vectors")
    classes = rows.where("fp is not null").groupBy("label", "size", "fp").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    counts = stored(classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")), "vector-labels")
    cells = classes.join(counts, ["label", "size"]).select("node", "label", "size", "n", "unit").mapInArrow(
        _celled(threshold), "cell long, node long, t int, bits int")
    cells = stored(cells, "vector-cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = stored(sizes.select("cell", F.ceil(F.col("m") / float(BLOCK)).alias("n_blocks")), "vector-cell-sizes")

    placed = cells.join(sizes, "cell").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).withColumn(
        "second", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))))
    low, high = F.least("block", "second"), F.greatest("block", "second")
    side = F.when(low != high, (F.col("block") == high).cast("int")).otherwise(-1)
    dealt = placed.select(F.xxhash64("cell", low, high).alias("g"), side.alias("side"), "t", "bits", "node")
    codes = stored(classes.select("node", "copies", "unit", "size").mapInArrow(
        _with_codes, f"node long, copies long, {CODES}"), "vector-codes")
    names = [c.split()[0] for c in CODES.split(", ")]

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition("g").sortWithinPartitions("g")

    blocks = dealt.select("g", "side", "node").join(codes.drop("copies"), "node").select("g", "side", "node", *names)
    opened = stored(in_blocks(blocks).mapInArrow(_opened(threshold), "g long, node long"), "vector-undecided")
    exact = dealt.join(opened, ["g", "node"]).join(codes, "node").join(classes.select("node", "unit"), "node").select(
        "g", "side", "t", "bits", "node", "copies", "unit", *names)
    found = stored(in_blocks(exact).mapInArrow(_compared(threshold), FOUND), "vector-links")

    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = stored(found.groupBy("node").agg(F.sum("links").alias("links")), "vector-counts")
    named = stored(classes.select("label", "size", "fp", "vec_id", "copies", "node").join(comp, "node", "left").join(
        linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "vector-named")
    least = stored(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "vector-least")
    of_class = stored(named.join(least, "root").select(
        "label", "size", "fp", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-of-class")
    full = rows.where("fp is not null").alias("r").join(of_class.alias("c"), same("r", "c", "label", "size", "fp")).select(
        "r.vec_id", "c.n_links", "c.component_id")
    bare = rows.where("fp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
