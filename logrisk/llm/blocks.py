"""A stated set of queries against all rows, in blocks, and the first rows of each key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logrisk.llm.common import stored

#: Numbers of one side of a block (rows times components), and the most rows of a side.
NUMBERS = 1 << 19
ROWS, QUERIES = 8192, 1024
#: Parts of a key whose first rows are chosen before those of the key.
PARTS = 64
#: Columns of the rows and queries of `vectors_of`.
IDS = ["vec_id", "fp"]


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id (long), label, fp, v: vectors as whole numbers, floor(scale * x) with x as double.

    rows: vec_id, embedding and perhaps label (further columns are not read).
    Vectors that are null or hold null or non-finite components are left out;
    empty ones stay. Rows that repeat in all of these columns are one row. fp
    tells rows of one id from each other.
    """
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("long")
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                    F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(F.col("x").isNotNull()).where(~bad)
    v = x.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * float(scale))).alias("v"))
    v = v.withColumn("fp", F.xxhash64("label", "v"))
    return stored(v.groupBy("vec_id", "fp").agg(F.first("label").alias("label"), F.first("v").alias("v")), "whole-vectors")


def in_blocks(rows: DataFrame, queries: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], columns: list[str]) -> DataFrame:
    """work(rows, queries) of every block of rows with every block of queries: `columns`, all long.

    Both sides hold vec_id, fp and v. Blocks go by a hash of (vec_id, fp), which
    no two rows share, so they are even; their number follows the counts, so a
    block is bounded however many rows there are. A side is sent once for each
    block of the other one.
    """
    sizes = [df.agg(F.count(F.lit(1)), F.max(F.size("v"))).first() for df in (rows, queries)]
    width = max(1, *(s[1] or 0 for s in sizes))
    n_rows, n_queries = (max(1, -(-s[0] // max(1, min(most, NUMBERS // width)))) for s, most in zip(sizes, (ROWS, QUERIES)))
    number = lambda n: F.pmod(F.xxhash64(*IDS), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("row_block", number(n_rows)).withColumn("query_block", every(n_queries))
    # New names for the columns: those of both sides often come from one table.
    right = queries.select(*[F.col(c).alias(c) for c in queries.columns]).withColumn("row_block", every(n_rows)).withColumn("query_block", number(n_queries))
    keys = ["row_block", "query_block"]

    def both(theirs: pa.Table, asked: pa.Table) -> pa.Table:
        if theirs.num_rows and asked.num_rows:
            return work(theirs, asked)
        return pa.table({c: pa.array([], pa.int64()) for c in columns})

    schema = ", ".join(f"{c} long" for c in columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, schema)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros."""
    out = np.zeros((len(column), width), np.int64)
    for row, v in zip(out, column.to_pylist()):
        row[:len(v)] = v
    return out


def widest(*columns: pa.ChunkedArray) -> int:
    return max((len(v) for c in columns for v in c.to_pylist()), default=0)


def by_id(table: pa.Table) -> pa.Table:
    """The rows by ascending vec_id, null last: places then stand for the order among equal scores."""
    return table.sort_by([("vec_id", "ascending"), ("fp", "ascending")])


def others(rows: pa.Table, vec_id: int | None) -> np.ndarray:
    """Whether each row has another id."""
    if vec_id is None:
        return np.array(rows["vec_id"].is_valid().to_pylist(), bool)
    ids = rows["vec_id"].to_numpy(zero_copy_only=False) if not rows["vec_id"].null_count else None
    if ids is None:
        return np.array([x != vec_id for x in rows["vec_id"].to_pylist()], bool)
    return ids != vec_id


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with rank from 1.

    Parts of a key are cut first, so no task sorts all rows of one.
    """
    part = df.withColumn("part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
    rank = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    part = part.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank", "part")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
